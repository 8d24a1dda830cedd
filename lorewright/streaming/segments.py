"""STR5, STR6, A10: tokens to sentence-like segments, with formulas kept whole."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that end a sentence, a clause, and the least sizes of the rules.
ENDS, COMMAS = "。！？!?.；;\n", "，,、"
COMMA_FROM, LEAST_LETTERS = 30, 8

_DELIMITERS = re.compile(r"\$\$|\$|\\\(|\\\)|\\\[|\\\]")
_FORMULA = re.compile(r"\$\$.+?\$\$|\$[^$\n]+?\$|\\\(.+?\\\)|\\\[.+?\\\]", re.S)
_MEANT = re.compile(r"[^\W\d_]")


def open_at(text: str) -> int:
    """Where the delimiter stands that is still open at the end of ``text``, else -1."""
    stack: list[tuple[str, int]] = []
    pairs = {r"\)": r"\(", r"\]": r"\["}
    for m in _DELIMITERS.finditer(text):
        d = m[0]
        if d in ("$", "$$"):
            if stack and stack[-1][0] == d:
                stack.pop()
            elif not stack:
                stack.append((d, m.start()))
        elif d in pairs:
            if stack and stack[-1][0] == pairs[d]:
                stack.pop()
        elif not stack:
            stack.append((d, m.start()))
    return stack[0][1] if stack else -1


def cuts_formula(text: str, at: int) -> bool:
    """Whether a cut before position ``at`` goes through a complete formula."""
    return any(m.start() < at < m.end() for m in _FORMULA.finditer(text))


def is_decimal_point(text: str, at: int) -> bool:
    """A dot after a digit, with a digit or nothing (yet) behind it."""
    return text[at] == "." and at > 0 and text[at - 1].isdigit() and (at + 1 == len(text) or text[at + 1].isdigit())


def is_meant(segment: str) -> bool:
    """Long enough to be emitted by itself, with a letter."""
    return len(segment.strip()) >= LEAST_LETTERS and bool(_MEANT.search(segment))


#: Segments of nothing but these, and of one short word with a mark, stand by themselves nowhere.
_MARKS_ONLY, _SHORT_PREFIX, _PREFIX_FROM = re.compile(r"^[\s。！？.,;:!?\-—*•]+$"), re.compile(r"^[0-9a-zA-Z]+[.：:]$"), 5


def has_formula(text: str) -> bool:
    """SUP36: a closed formula, a delimiter without its other half, or a bare box."""
    plain = text.replace("\\$", "")
    odd = plain.count("$$") % 2 or plain.replace("$$", "").count("$") % 2
    uneven = text.count(r"\(") != text.count(r"\)") or text.count(r"\[") != text.count(r"\]")
    return bool(_FORMULA.search(text) or odd or uneven or re.search(r"\\boxed\s*\{", text))


def segment_marks(text: Column) -> dict[str, Column]:
    """SUP36 as columns: holds a formula, is meant by itself (8 characters, a letter), is nothing but marks, is a short prefix."""
    plain = F.replace(text, F.lit("\\$"), F.lit(""))
    count = lambda t, part: (F.char_length(t) - F.char_length(F.replace(t, F.lit(part), F.lit("")))) / len(part)
    uneven = [count(text, a) != count(text, b) for a, b in (("\\(", "\\)"), ("\\[", "\\]"))]
    odd = (count(plain, "$$") % 2 == 1) | (count(F.replace(plain, F.lit("$$"), F.lit("")), "$") % 2 == 1)
    return {
        "formula": F.rlike(text, F.lit(f"(?s){_FORMULA.pattern}")) | odd | uneven[0] | uneven[1] | F.rlike(text, F.lit(r"\\boxed\s*\{")),
        "meant": (F.char_length(text) >= LEAST_LETTERS) & F.rlike(text, F.lit("[a-zA-Z一-龥]")),
        "marks": F.rlike(text, F.lit(_MARKS_ONLY.pattern)),
        "prefix": (F.char_length(text) < _PREFIX_FROM) & F.rlike(text, F.lit(_SHORT_PREFIX.pattern)),
    }


def merged(segments: list[str]) -> list[str]:
    """STR6: marks go to the segment before them, or at the start to the one behind; a short prefix goes to the one behind."""
    out: list[str] = []
    ahead, prefixed = "", False
    for s in segments:
        marks, prefix = bool(_MARKS_ONLY.match(s)), len(s) < _PREFIX_FROM and bool(_SHORT_PREFIX.match(s))
        if prefix or (marks and not prefixed and not out) or (prefixed and s == "\n"):
            ahead, prefixed = ahead + s, prefixed or prefix
        elif marks and not prefixed:
            out[-1] += s
        else:
            out.append(ahead + s)
            ahead, prefixed = "", False
    return out + [ahead] if ahead else out


@dataclass
class SegmentBuffer:
    """State of one stream: what is not emitted yet, and a held segment that was too short."""

    limit: int = 100
    buffer: str = ""
    held: str = ""

    def _cut(self) -> int:
        """How much of the buffer makes a segment now; 0 to wait."""
        text = self.buffer
        opener = open_at(text)
        for i in range(len(text) - 1, -1, -1):
            if text[i] in ENDS and not is_decimal_point(text, i) and open_at(text[: i + 1]) < 0 and not cuts_formula(text, i + 1):
                return i + 1
        if opener < 0 and len(text) >= COMMA_FROM:
            for i in range(len(text) - 1, -1, -1):
                if text[i] in COMMAS and not cuts_formula(text, i + 1):
                    return i + 1
        limit = 2 * self.limit if opener >= 0 and not _FORMULA.search(text) else self.limit
        if len(text) < limit:
            return 0
        if opener >= 0:
            return opener  # before the opener; at 0 there is nothing to cut, so wait
        if cuts_formula(text, self.limit):
            return 0
        near = range(min(len(text), limit), max(0, limit - 20), -1)
        for wanted in (str.isspace, lambda c: c in ENDS + COMMAS + ":："):
            for i in near:
                if wanted(text[i - 1]) and not cuts_formula(text, i):
                    return i
        return min(len(text), limit)

    def feed(self, token: str) -> str | None:
        """At most one segment for a token; what is left waits for the next one."""
        self.buffer += token
        at = self._cut()
        if at <= 0:
            return None
        segment, self.buffer = self.held + self.buffer[:at], self.buffer[at:]
        if is_meant(segment):
            self.held = ""
            return segment
        self.held = segment
        return None

    def tick(self) -> str | None:
        """The time limit has passed: everything goes, unless a formula is open."""
        return None if open_at(self.buffer) >= 0 else self.flush()

    def flush(self) -> str | None:
        out, self.held, self.buffer = self.held + self.buffer, "", ""
        return out or None
