r"""Formula text (TX1-TX12): delimiters, boxes, environments, extraction.

The scanners are sequential, so they run as Arrow-batched Pandas UDFs around small pure functions;
what a regular expression can say stays a column expression.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PAIRS = ((r"\\{1,3}\(", "$"), (r"\\{1,3}\)", "$"), (r"\\{1,3}\[", "$$"), (r"\\{1,3}\]", "$$"))
FORMULA = re.compile(r"(?<!\\)\$\$(.+?)(?<!\\)\$\$|(?<![\\$])\$([^$]+?)(?<!\\)\$(?!\$)", re.S)


def unified_delimiters(text: Column) -> Column:
    r"""TX1: \( \) \[ \] with one to three backslashes become $ and $$."""
    for pattern, by in _PAIRS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(by.replace("$", r"\$")))
    return text


def trim_inside(text: str) -> str:
    """TX2: no white space next to inline delimiters, no spaces next to display ones; an escaped dollar is no delimiter."""
    def inner(m: re.Match) -> str:
        return f"$${m[1].strip(' ')}$$" if m[1] is not None else f"${m[2].strip()}$"

    return FORMULA.sub(inner, text)


def braces_end(text: str, at: int) -> int:
    """The position after the brace that closes the one at ``at``, -1 if none does."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] in "{}" and (i == 0 or text[i - 1] != "\\"):
            depth += 1 if text[i] == "{" else -1
            if depth == 0:
                return i + 1
    return -1


def _inside(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in FORMULA.finditer(text)]


def wrap_bare_boxes(text: str) -> str:
    r"""TX3: \boxed{...} outside of formulas becomes one."""
    spans, out, at = _inside(text), [], 0
    for m in re.finditer(r"\\boxed\s*\{", text):
        if m.start() < at or any(a <= m.start() < b for a, b in spans):
            continue
        end = braces_end(text, m.end() - 1)
        if end > 0:
            out += [text[at : m.start()], "$", text[m.start() : end], "$"]
            at = end
    return "".join(out) + text[at:]


_TABULAR = re.compile(r"\\begin\{tabular\}(.*?)\\end\{tabular\}", re.S)
_ENVIRONMENT = re.compile(r"\\begin\{(array|aligned?\*?|cases|[bpvBV]?matrix|gathered|equation\*?)\}.*?\\end\{\1\}", re.S)


def tabular_to_array(text: str) -> str:
    """TX4: tables become arrays, without dollars inside."""
    return _TABULAR.sub(lambda m: r"\begin{array}" + re.sub(r"(?<!\\)\$", "", m[1]) + r"\end{array}", text)


def wrap_bare_environments(text: str) -> str:
    """TX5: environments outside of formulas become display formulas."""
    spans, out, at = _inside(text), [], 0
    for m in _ENVIRONMENT.finditer(text):
        if m.start() >= at and not any(a <= m.start() < b for a, b in spans):
            out += [text[at : m.start()], "$$", m[0], "$$"]
            at = m.end()
    return "".join(out) + text[at:]


def _unified(text: str) -> str:
    for pattern, by in _PAIRS:
        text = re.sub(pattern, lambda _, by=by: by, text)
    return text


#: Fixed value: a degree sign, and the sign of the side from which a limit is taken.
_DEGREE_LIMIT = r"(\\circ)\s*\^\s*(?:\{?\s*([+-])\s*\}?)"


def _degree_limit(text: str) -> str:
    return re.sub(_DEGREE_LIMIT, r"\1{}^{\2}", text) if r"\circ^" in text else text


def degree_limits(text: Column) -> Column:
    r"""TX6 as a column: the sign of a one-sided limit at \circ gets an empty base; texts without "\circ^" stay."""
    return F.when(F.contains(text, F.lit(r"\circ^")), F.regexp_replace(text, _DEGREE_LIMIT, r"$1{}^{$2}")).otherwise(text)


def normalise(text: str | None) -> str | None:
    r"""TX7: TX1 to TX5, then \text becomes \mathrm, and one-sided limits at a degree sign are repaired (TX6)."""
    if text is None:
        return None
    for step in (_unified, trim_inside, wrap_bare_boxes, tabular_to_array, wrap_bare_environments):
        text = step(text)
    text = re.sub(r"\\text\s*\{", r"\\mathrm{", text)
    text = re.sub(r"\^\s*\{?\s*°\s*\}?", r"^{\\circ}", text)
    return _degree_limit(text)


@F.pandas_udf(T.StringType())
def normalised(texts: pd.Series) -> pd.Series:
    """TX7 as a column."""
    return texts.map(normalise, na_action="ignore")


_FOUND = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("kind", T.StringType()).add("body", T.StringType()))


@F.pandas_udf(_FOUND)
def formulas(texts: pd.Series) -> pd.Series:
    """TX9: every formula with its place, kind and body."""
    def find(text: str | None) -> list[dict]:
        return [
            {"start": m.start(), "end": m.end(), "kind": "display" if m[1] is not None else "inline", "body": m[1] if m[1] is not None else m[2]}
            for m in FORMULA.finditer(text or "")
        ]

    return texts.map(find)


def strip_wrappers(text: str | None) -> str | None:
    """TX10: outer delimiters and boxes go, nested ones too."""
    if text is None:
        return None
    while True:
        text = text.strip()
        m = re.fullmatch(r"\$\$(.+)\$\$|\$(.+)\$|\\\((.+)\\\)|\\\[(.+)\\\]", text, re.S)
        if m:
            text = next(g for g in m.groups() if g is not None)
            continue
        b = re.match(r"\\boxed\s*\{", text)
        if b and braces_end(text, b.end() - 1) == len(text):
            text = text[b.end() : -1]
            continue
        return text


@F.pandas_udf(T.StringType())
def unwrapped(texts: pd.Series) -> pd.Series:
    """TX10 as a column."""
    return texts.map(strip_wrappers, na_action="ignore")


def has_formula(text: Column) -> Column:
    """TX12."""
    return F.rlike(text, F.lit(r"\$[^$]+\$|\\\(.+?\\\)|\\\[.+?\\\]|\\boxed\s*\{|\\begin\{"))


def is_simple(text: Column) -> Column:
    """TX10: a bare number, variable or single operation."""
    return F.rlike(text, F.lit(r"^\s*-?(?:\d+(?:\.\d+)?|[A-Za-z])(?:\s*[-+*/=]\s*-?(?:\d+(?:\.\d+)?|[A-Za-z]))?\s*$"))


def placeholders(text: str) -> tuple[str, dict[str, str]]:
    """TX11: formulas replaced by numbered placeholders, and what stands for each."""
    table: dict[str, str] = {}

    def put(m: re.Match) -> str:
        name = f"⟦F{len(table)}⟧"
        table[name] = m[0]
        return name

    return FORMULA.sub(put, text), table


def restore(text: str, table: dict[str, str]) -> str:
    """TX11: the inverse."""
    return re.sub(r"⟦F\d+⟧", lambda m: table.get(m[0], m[0]), text)


def _column(f):
    """A pure function of one text as a column; null stays null."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action="ignore")

    return run


#: TX2 to TX5 and TX11 as columns.
trimmed, boxed, tabled, displayed = map(_column, (trim_inside, wrap_bare_boxes, tabular_to_array, wrap_bare_environments))
put_back = _column(lambda text: restore(*placeholders(text)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def normalised_list(lists: pd.Series) -> pd.Series:
    """TX8: TX7 on every text of a list."""
    return lists.map(lambda texts: [normalise(t) for t in texts], na_action="ignore")


def repaired(fields: list[str], steps: str) -> dict[str, Column]:
    """TX8: the columns of a record with repaired formulas, in its text fields and in the texts of its steps."""
    return {**{c: normalised(F.col(c)) for c in fields}, steps: normalised_list(F.transform(steps, lambda x: x["text"]))}


@F.pandas_udf(T.StructType().add("text", T.StringType()).add("n", T.LongType()).add("first", T.StringType()))
def set_aside(texts: pd.Series) -> pd.DataFrame:
    """SUP29: texts with placeholders for their formulas, how many, and the first one."""
    rows = [placeholders(t or "") for t in texts]
    return pd.DataFrame({"text": [t for t, _ in rows], "n": [len(d) for _, d in rows], "first": [next(iter(d.values()), None) for _, d in rows]})
