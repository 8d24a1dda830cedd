"""STR7, STR8, A11: removal of think blocks from token streams, however tokens cut them.

One character at a time through four states: outside, a possible opening tag, inside, a possible
closing tag. A tag that turns out not to be one is passed on as it stands, with the character that
decided it, even if that is another "<". An unfinished block is dropped at the end of the stream; an
unfinished opening tag is text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

OPEN, CLOSE, TAG_LIMIT = "<think", "</think", 256


@dataclass
class ThinkFilter:
    """State of one stream; plain fields only, so that it can be kept as a state row."""

    mode: str = "outside"
    held: str = ""
    block: str = ""
    blocks: list[str] = field(default_factory=list)

    def _fits(self, name: str) -> bool | None:
        """Whether ``held`` is a whole tag (True), may become one (None), or can't (False)."""
        text = self.held.lower()
        if len(text) > TAG_LIMIT:
            return False
        if len(text) <= len(name):
            return None if name.startswith(text) else False
        if not text.startswith(name):
            return False
        rest = text[len(name) :]
        if rest[0] != ">" and not rest[0].isspace():
            return False
        return True if rest.endswith(">") else None

    def feed(self, text: str) -> str:
        """The part of the stream that is to be shown after ``text``."""
        out = []
        for c in text:
            if self.mode in ("outside", "inside"):
                if c == "<":
                    self.held = c
                    self.mode = "opening" if self.mode == "outside" else "closing"
                elif self.mode == "outside":
                    out.append(c)
                else:
                    self.block += c
                continue
            self.held += c
            fits = self._fits(OPEN if self.mode == "opening" else CLOSE)
            if fits is None:
                continue
            if self.mode == "opening":
                self.mode = "inside" if fits else "outside"
                if not fits:
                    out.append(self.held)
            else:
                if fits:
                    self.blocks.append(self.block)
                    self.block = ""
                else:
                    self.block += self.held
                self.mode = "outside" if fits else "inside"
            self.held = ""
        return "".join(out)

    def flush(self) -> str:
        """The end of the stream."""
        out = self.held if self.mode == "opening" else ""
        self.mode, self.held, self.block = "outside", "", ""
        return out


def strip(text: str | None) -> str:
    """A whole text through the filter."""
    f = ThinkFilter()
    return f.feed(text or "") + f.flush()
