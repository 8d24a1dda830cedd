"""Markdown as a table function: numbered lines, image references and line ranges of a text in one pass (SRC10, SUP22)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_IMAGE = re.compile(r"!\[([^\]]*)\]\(\s*(?:<([^>]*)>|([^)\s]+))(?:\s+\"[^\"]*\")?\s*\)")


class _MarkdownLines:
    def eval(self, text: str) -> Iterator[tuple]:
        """A row for each line, and one more for each further image in it; ``until`` ends the paragraph that the line is in."""
        lines = (text or "").split("\n")
        ends, end = [0] * len(lines), len(lines)
        for i in range(len(lines) - 1, -1, -1):
            blank = not lines[i].strip()
            ends[i] = end = i + 1 if blank or i + 1 == len(lines) or not lines[i + 1].strip() else end
        for i, line in enumerate(lines):
            images = [(m[1], (m[2] or m[3] or "").strip()) for m in _IMAGE.finditer(line)]
            for alt, path in images or [(None, None)]:
                yield i + 1, line, ends[i], alt, path


MARKDOWN_COLUMNS = "line_no: long, line: string, until: long, alt: string, image_path: string"

#: ``markdown_lines(text)``: called laterally, once for each row of a table.
markdown_lines = udtf(_MarkdownLines, returnType=MARKDOWN_COLUMNS, useArrow=True)


def register(spark: SparkSession) -> None:
    """``markdown_lines`` for SQL."""
    spark.udtf.register("markdown_lines", markdown_lines)
