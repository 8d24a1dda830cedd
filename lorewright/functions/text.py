r"""String rules as columns (ST1-ST49). Everything here stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the range of unified ideographs that counts as Chinese text.
CJK = r"\x{4e00}-\x{9fff}"


#: Defaults of parameters: short lists of this repository for texts of mathematics; callers bring longer ones.
CONCEPT_WORDS = ("什么是", "是什么", "定义", "概念", "推导", "证明过程", "异同", "区别")
TEACHING_WORDS = ("教材", "课本", "课程", "学习了", "学过")
POINTING_WORDS = ("它", "这个", "那个", "这些", "那些", "上面", "前面", "刚才", "再算")
OPENING_WORDS = ("什么是", "介绍一下", "定义", "定理", "公式")
MATH_WORDS = (
    "三角形", "正方体", "圆锥", "圆的", "函数", "方程", "不等式", "数列", "集合", "向量", "导数", "积分", "面积", "体积", "周长", "最大值", "最小值",
    "求解", "求证", "求值", "证明", "化简", "等于多少", "平方",
)

#: Words of follow-up questions, of a problem's own text, and of questions that are not simple.
FOLLOW_UP_WORDS = (
    "第二问", "第三问", "第一问", "上一问", "下一问", "刚才", "上面", "前面", "这个", "这一步", "这里", "它", "继续",
    "为什么", "哪里错", "怎么做", "怎么解", "答案不对", "重新解", "接着",
)
COMPLETE_WORDS = ("已知", "设", "若", "求", "证明")
NOT_SIMPLE_WORDS = ("证明", "推导", "分析", "为什么", "思路", "过程", "几何", "应用题", "函数", "方程组")
#: The class of a reason by its words, and verbs with their translations.
REASONS = (
    ("数学概念", ("集合", "函数", "定理", "公式", "定义", "什么是")),
    ("数学推理", ("证明", "推导", "为什么")),
    ("综合分析", ("分析", "比较", "总结")),
)
MATH_VERBS = {"discard": "舍去", "obtain": "得到", "substitute": "代入", "assume": "假设", "conclude": "得出", "simplify": "化简"}
#: Marks of parts and options in model outputs.
OUTPUT_LABELS = r"^(?:(?:输出|结果)[：:]\s*)+"
SPOKEN_PART = r"(^|[\n。！？；;，,、]\s*)(?:第\s*([一二三123１２３])\s*(?:问|小题|小问)|问题\s*([一二三123１２３]))[，,、。．:\s]*"
CHOICE_CONTEXT = r"下列选项哪个正确|下列说法正确的是|下列结论正确的是|下列.*?正确的是|下列.*?错误的是|这是一道多选题|这是一道单选题|多选题|单选题|选择题"
CHOICE_MARK = r"(?:\$\s*([A-Da-d])\s*\$\s*选项|([A-Da-d])\s*选项|选项\s*\$\s*([A-Da-d])\s*\$|选项\s*([A-Da-d]))[：:，,、\s]*"


def contains_any(text: Column, words) -> Column:
    return F.rlike(text, F.lit("|".join(words)))


def numbered_parts(text: Column) -> Column:
    """ST17: spoken marks of sub-questions become (n); after a full stop they open a paragraph."""
    digit = {"一": 1, "二": 2, "三": 3, "１": 1, "２": 2, "３": 3}
    out = _sub(text, SPOKEN_PART, r"$1\(⟦$2$3⟧\)")
    out = _sub(out, r"([。！？；;])\s*(?=\(⟦)", "$1\n\n")
    for word, n in digit.items():
        out = F.replace(out, F.lit(f"(⟦{word}⟧)"), F.lit(f"({n})"))
    return _sub(out, r"\(⟦([123])⟧\)", r"\($1\)")


def choice_lines(text: Column) -> Column:
    """ST18: marks of options become "A. " on a line of their own, in a choice question only."""
    marked = lambda x: F.rlike(text, F.lit(rf"(?i)\$?\s*{x}\s*\$?\s*选项|选项\s*\$?\s*{x}"))
    context = F.rlike(text, F.lit(CHOICE_CONTEXT)) | (marked("a") & marked("b") & marked("c") & marked("d"))
    out = _sub(text, CHOICE_MARK, "⟦$1$2$3$4⟧")
    out = _sub(out, r"则[，,：:]?\s*(?=⟦[A-Da-d]⟧)", "则：\n")
    out = _sub(out, r"(?<=[^\s])[^\S\n]*(?=⟦[A-Da-d]⟧)", "\n")
    for x in "abcd":
        out = F.replace(F.replace(out, F.lit(f"⟦{x}⟧"), F.lit(f"{x.upper()}. ")), F.lit(f"⟦{x.upper()}⟧"), F.lit(f"{x.upper()}. "))
    out = _sub(_sub(out, r"\n{3,}", "\n\n"), r"\A\s+|\s+\z")
    return F.when(context & F.rlike(text, F.lit(CHOICE_MARK)), out).otherwise(text)


def clean_output(text: Column) -> Column:
    """ST16: think blocks, fence, labels and quotes of model output go, then ST17 and ST18."""
    bare = _sub(_sub(strip_code_fence(strip_think(text)), OUTPUT_LABELS), r"\A[\s\"]+|[\s\"]+\z")
    return F.trim(choice_lines(numbered_parts(F.btrim(bare, F.lit(" '")))))


def translated_verbs(text: Column) -> Column:
    """ST24: English verbs of mathematics become Chinese, in Chinese texts with a formula only."""
    out = text
    for word, by in MATH_VERBS.items():
        out = _sub(out, rf"(?i)\b{word}\b", by)
    formula = F.rlike(text, F.lit(r"\$[^$]+\$|\\\(.+?\\\)|\\\[.+?\\\]|\\boxed\s*\{|\\begin\{"))
    return F.when(F.rlike(text, F.lit(f"[{CJK}]")) & formula, out).otherwise(text)


def is_math_problem(text: Column, words: tuple[str, ...] = MATH_WORDS) -> Column:
    """ST27: holds one of ``words`` (expressions)."""
    return contains_any(F.trim(text), words)


def is_follow_up(text: Column) -> Column:
    """ST30: at most 80 characters with a word that refers back; 80 and a problem's own words make a problem."""
    q = F.trim(text)
    n = F.char_length(q)
    return (n > 0) & ~((n >= 80) & contains_any(q, COMPLETE_WORDS)) & (n <= 80) & contains_any(q, FOLLOW_UP_WORDS)


def is_simple_arithmetic(text: Column) -> Column:
    """ST31."""
    q = F.lower(F.trim(text))
    number, sign = F.rlike(q, F.lit("[0-9一二三四五六七八九十百千万两零]")), F.rlike(q, F.lit("[-+*/加减乘除×÷]|等于"))
    asks = F.rlike(q, F.lit("等于几|多少|=|＝"))
    return (F.char_length(q).between(1, 28)) & ~contains_any(q, NOT_SIMPLE_WORDS) & number & sign & asks


def reason_class(text: Column) -> Column:
    """ST33."""
    return F.coalesce(*[F.when(contains_any(text, words), F.lit(name)) for name, words in REASONS], F.lit("heuristic"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def traffic_place(text: Column) -> Column:
    """ST35: the place in a question about traffic, null if there is none.

    A place has at most 20 characters and one of four words behind it, so it is looked for from 20 characters
    before the first of these words on.
    """
    words = ("堵不堵", "拥堵", "路况", "交通")
    any_word = "|".join(words)

    def named(q: Column) -> Column:
        first = F.least(*[F.nullif(F.instr(q, w), F.lit(0)) for w in words])
        near = F.coalesce(F.substr(q, F.greatest(F.lit(1), first - 20)), F.lit(""))
        found = F.regexp_extract(near, rf"([{CJK}A-Za-z]{{2,20}})(?:{any_word})", 1)
        return F.trim(_sub(F.trim(_sub(found, "^(?:请问|我想了解一下|想了解一下|帮我查一下|查一下|今天|今日|现在)")), "(?:今天|今日|现在)$"))

    def rest(q: Column) -> Column:
        """The letters without words of traffic and day; with 21 that are in none of these words there are too many."""
        in_words = "".join(sorted({*any_word, *"今天今日现在"} - {"|"}))
        stays = rf"[A-Za-z{CJK}&&[^{in_words}]]"
        many = rf"\A(?:[[^A-Za-z{CJK}]{in_words}]*+{stays}){{21}}"
        letters = _sub(_sub(q, f"[^{CJK}A-Za-z]+"), f"{any_word}|今天|今日|现在")
        return F.when(~F.rlike(q, F.lit(many)), _once(letters, lambda r: F.when(F.char_length(r).between(2, 20), r)))

    return _once(F.trim(text), lambda q: _once(named(q), lambda bare: F.when(bare != "", bare).otherwise(rest(q))))


_LEAD = "请问|麻烦问下|麻烦下|麻烦您|麻烦|问下|请帮我查一下|帮我查一下|我想了解一下|我想了解|想了解一下|想了解|了解一下|了解|想知道|请告诉我|告诉我|请|查一下"
_WEATHER = "天气|气温|气候|阴晴|降雨|下雨|下雪|气象"


def weather_place(text: Column) -> Column:
    """ST35: the place in a question about the weather: before a day or weather word, before the weather word
    without manners and days, after an English preposition, else the ideographs alone; null if there is none."""
    q = F.trim(text)
    first = F.regexp_extract(F.trim(_sub(q, rf"^(?:{_LEAD})\s*")), rf"([{CJK}]{{2,4}}?)(?=今天|今日|明天|后天|本周|这周|当前|现在|此时|目前|的天气|的气温|的气候|{_WEATHER})", 1)
    second = F.trim(F.regexp_extract(q, rf"([{CJK}A-Za-z]{{2,20}})\s*(?:的)?\s*(?:{_WEATHER})", 1))
    for _ in range(3):
        second = F.trim(_sub(second, "^(?:请问|麻烦问下|问下|请帮我查一下|帮我查一下|今天|今日|明天|后天|当前|现在|的)"))
        second = F.trim(_sub(second, "(?:今天|今日|明天|后天|本周|这周|当前|现在|的)$"))
    english = F.trim(_sub(F.regexp_extract(q, r"\b(?:in|at|for|of|near|around)\s+([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,3})", 1), r"(?i)\s+(?:today|tomorrow|now|tonight|currently|right\s+now)\s*$"))
    only = _sub(q, f"[^{CJK}]")
    return F.when(F.char_length(first) >= 2, first).when(F.char_length(second) >= 2, second).when(english != "", english).when(F.char_length(only).between(2, 20), only)


def chunk_text(head: dict[str, Column], body: Column, part: Column) -> Column:
    """ST43: header lines, the part only where there is one, then the body."""
    lines = [F.concat(F.lit(f"【{name}】"), F.coalesce(v, F.lit(""))) for name, v in head.items()]
    lines.append(F.when(F.coalesce(part, F.lit("")) != "", F.concat(F.lit("【分片】"), part)))
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\n【正文】\n"), body)


def conversion_log(entry: Column) -> Column:
    """ST45: type, duration, before and after of a conversion's log entry, quoted or not; null if it is none."""
    payload = F.regexp_extract(entry, r"(?s)(ASR→LaTeX.*)", 1)
    quoted = r"(?s)before\s*=\s*'(.*?)'\s*,\s*after\s*=\s*'(.*?)(?:'\s*)?$"
    plain = r"(?s)before\s*=\s*(.*?)\s*,\s*after\s*=\s*(.*?)(?:,\s*duration=[^,\n]+)?$"
    is_quoted = F.rlike(payload, F.lit(quoted))
    value = lambda i: F.trim(F.when(is_quoted, F.regexp_extract(payload, quoted, i)).otherwise(_sub(F.trim(F.regexp_extract(payload, plain, i)), "^'|'$")))
    duration = F.nullif(F.trim(F.regexp_extract(payload, "duration=([^,]+)", 1)), F.lit(""))
    row = F.struct(F.trim(F.substring_index(payload, ":", 1)).alias("type"), duration.alias("duration"), value(1).alias("before"), value(2).alias("after"))
    return F.when((payload != "") & (is_quoted | F.rlike(payload, F.lit(plain))), row)


def parsed_name(name: Column) -> Column:
    """ST46: the plain name of a parser's export, null for other files."""
    forms = ((r"^MinerU_(.+?)__\d{14}\.json$", ".json"), (r"^MinerU_markdown_(.+?)_\d{14}\.md$", ".md"), (r"^MinerU_markdown_(.+?)_\d{16}_\d+\.md$", ".md"))
    return F.coalesce(*[F.when(F.rlike(name, F.lit(p)), F.concat(F.regexp_extract(name, p, 1), F.lit(ext))) for p, ext in forms])


def _sub(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def clean_query(text: Column) -> Column:
    """ST1: leading punctuation and white space go."""
    return _sub(text, r"^[，。！？、；：,.?!;:\s]+")


def dominant_language(text: Column) -> Column:
    """ST2: zh with any ideograph, en with any Latin letter, else empty."""
    return F.when(F.rlike(text, F.lit(f"[{CJK}]")), "zh").when(F.rlike(text, F.lit("[A-Za-z]")), "en").otherwise("")


def language_drift(a: Column, b: Column) -> Column:
    """ST3: both languages known and different."""
    x, y = dominant_language(a), dominant_language(b)
    return (x != "") & (y != "") & (x != y)


def output_language(text: Column) -> Column:
    """ST4: the text's language, Chinese where there is none."""
    return F.when(dominant_language(text) == "en", "en").otherwise("zh")


def safe_file_name(text: Column, most: int = 50, default: str = "untitled") -> Column:
    """ST5: characters that file systems refuse become underscores."""
    name = F.substring(F.btrim(_sub(text, r'[\\/:*?"<>|\x00-\x1f]', "_"), F.lit(" .")), 1, most)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(default))


def plain_file_name(text: Column, most: int = 80) -> Column:
    """ST6: letters, digits and ideographs only, the rest collapses to one underscore."""
    return F.substring(F.btrim(_sub(text, f"[^{CJK}A-Za-z0-9]+", "_"), F.lit("_")), 1, most)


def slug(text: Column) -> Column:
    """ST7."""
    return F.btrim(_sub(_sub(F.lower(text), f"[^a-z0-9{CJK}]+", "_"), "_+", "_"), F.lit("_"))


def stable_id(*parts: Column, prefix: str = "") -> Column:
    """ST8: 16 hexadecimal digits of the SHA-1 of the parts joined by the unit separator."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("\x1f", *parts)), 1, 16))


def md5_id(text: Column, prefix: str = "") -> Column:
    """ST9."""
    return F.concat(F.lit(prefix), F.substring(F.md5(text), 1, 12))


def question_hash(text: Column) -> Column:
    """ST10."""
    return F.sha2(text, 256)


def rough_tokens(text: Column) -> Column:
    """ST11: one for each ideograph, one for four other characters."""
    cjk = F.char_length(_sub(text, f"[^{CJK}]"))
    return (cjk + F.ceil((F.char_length(text) - cjk) / 4)).cast("long")


def cut_for_embedding(text: Column, most: int = 384) -> Column:
    """ST12."""
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def one_spaced(text: Column) -> Column:
    """ST13: white space runs become one space, none at the ends."""
    return F.trim(_sub(text, r"\s+", " "))


def strip_think(text: Column) -> Column:
    """ST14: closed think blocks go."""
    return _sub(text, r"(?is)<think\b[^>]*>.*?</think\s*>")


def strip_think_tail(text: Column) -> tuple[Column, Column]:
    """ST14: closed blocks and an unclosed tail go; the second column tells whether there was a tail."""
    rest = strip_think(text)
    return _sub(rest, r"(?is)<think\b[^>]*>.*\z"), F.rlike(rest, F.lit(r"(?is)<think\b[^>]*>"))


def strip_code_fence(text: Column) -> Column:
    """ST15: the inside of a fence that encloses the whole text."""
    inner = F.regexp_extract(F.trim(text), r"(?s)^```[\w+-]*[ \t]*\n?(.*?)\n?```$", 1)
    return F.when(F.rlike(F.trim(text), F.lit(r"(?s)^```.*```$")), F.trim(inner)).otherwise(F.trim(text))


def sub_questions(text: Column) -> Column:
    """ST19: the parts that follow (1), (2) ...; empty when there are none."""
    return F.filter(F.transform(F.slice(F.split(text, r"[(（]\s*\d+\s*[)）]"), F.lit(2), F.char_length(text) + 1), lambda x: F.trim(x)), lambda x: x != "")


def split_question(text: Column) -> Column:
    """ST19: stem, parts and status (single, two_part, fallback)."""
    parts = sub_questions(text)
    n = F.size(parts)
    status = F.when(n == 0, "single").when(n == 2, "two_part").otherwise("fallback")
    return F.struct(F.trim(F.get(F.split(text, r"[(（]\s*\d+\s*[)）]"), 0)).alias("stem"), parts.alias("parts"), status.alias("status"))


def is_proof(text: Column) -> Column:
    """ST20."""
    return F.rlike(text, F.lit("(?i)证明|求证|prove|show that"))


def speech_text(text: Column) -> Column:
    """ST21: Markdown to what is read aloud."""
    out = _sub(text, r"(?s)```.*?```", " ")
    out = _sub(out, r"`([^`]*)`", "$1")
    out = _sub(out, r"!\[[^\]]*\]\([^)]*\)")
    out = _sub(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = _sub(out, r"(?m)^[ \t]*#{1,6}[ \t]*")
    out = _sub(out, r"(?m)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+")
    out = _sub(out, r"\*\*([^*]+)\*\*", "$1")
    out = _sub(out, r"\*([^*\n]+)\*", "$1")
    return F.trim(_sub(out, r"\n{2,}", "\n"))


def strip_list_markers(text: Column) -> Column:
    """ST22: markers go, the indent stays."""
    return _sub(text, r"(?m)^([ \t]*)(?:[-*+])[ \t]+", "$1")


def mapped_reply(text: Column, replies: dict[str, str]) -> Column:
    """ST23: exact, then by prefix or suffix in the order of the replies; the text itself if nothing fits."""
    steps = [F.when(text == k, F.lit(v)) for k, v in replies.items()]
    for k, v in replies.items():
        steps.append(F.when(F.startswith(text, F.lit(k)), F.concat(F.lit(v), F.substr(text, F.lit(len(k) + 1)))))
        steps.append(F.when(F.endswith(text, F.lit(k)), F.concat(F.left(text, F.char_length(text) - len(k)), F.lit(v))))
    return F.coalesce(*steps, text)


def guarded_rewrite(original: Column, rewritten: Column) -> Column:
    """ST25: an empty rewrite, one in another language, or an answer instead of a question is refused."""
    new = F.trim(F.coalesce(rewritten, F.lit("")))
    answered = F.char_length(new) > F.greatest(F.lit(80), 3 * F.char_length(original))
    return F.when((new == "") | language_drift(original, new) | answered, original).otherwise(new)


def depends_on_context(text: Column, pointing: tuple[str, ...] = POINTING_WORDS, opening: tuple[str, ...] = OPENING_WORDS) -> Column:
    """ST26: short, with a word that points backwards, and no subject of its own: no clause that opens with one, no name in capitals."""
    q = F.trim(text)
    subject = F.rlike(q, F.lit(rf"(?:^|[\s，,。.;；:：、])(?:{'|'.join(opening)})")) | F.rlike(q, F.lit(r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b"))
    return (q != "") & (F.char_length(q) <= 24) & contains_any(q, pointing) & ~subject


def explains_concept(text: Column, indicators: tuple[str, ...] = CONCEPT_WORDS, teaching: tuple[str, ...] = TEACHING_WORDS, least: int = 25) -> Column:
    """ST28: two of an indicator, a teaching context, and ``least`` characters."""
    met = (contains_any(text, indicators), contains_any(text, teaching), F.char_length(text) >= least)
    return sum((x.cast("int") for x in met), F.lit(0)) >= 2


def complexity(text: Column, reasoning: list[str], simple: list[str], office: tuple[list[str], list[str], list[str]]) -> Column:
    """ST32, A4: 0 to 10 from length, keywords, punctuation, simple patterns and office-holder questions."""
    has = lambda words: F.rlike(text, F.lit("(?i)" + "|".join(words)))
    n = F.char_length(text)
    score = F.lit(3) + F.when(n > 100, 2).when(n > 50, 1).otherwise(0) + F.when(has(reasoning), 2).otherwise(0)
    score = score + F.when(F.rlike(text, F.lit("[，。？?]")), 1).otherwise(0) - F.when(has(simple) & (n < 30), 1).otherwise(0)
    holder = has(office[0]) & has(office[1]) & has(office[2])
    return F.least(F.lit(10), F.greatest(F.lit(0), F.when(holder, F.greatest(score, F.lit(8))).otherwise(score)))


def alias_of(text: Column, aliases: dict[str, str], default: str) -> Column:
    """ST34: a label by its alias."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(text))), F.lit(default))


def has_math(text: Column) -> Column:
    """ST36."""
    return F.rlike(text, F.lit(r"[=+×÷√∑∫≤≥≠∞π^]|\\[a-zA-Z]+|\d\s*[-*/]\s*\d"))


def normal_title(text: Column) -> Column:
    """ST37: without Markdown signs, white space and case."""
    return F.lower(_sub(_sub(_sub(text, r"^\s*#+\s*"), r"[*_`]"), r"\s+"))


def number_key(text: Column) -> Column:
    """ST37: the numbering at a title's start without leading zeros, else empty."""
    found = F.regexp_extract(text, r"^\s*#*\s*(\d+(?:\.\d+)*)", 1)
    return F.array_join(F.transform(F.split(found, r"\."), lambda x: _sub(x, r"^0+(?=\d)")), ".")


def is_heading(text: Column) -> Column:
    return F.rlike(text, F.lit(r"^\s{0,3}#{1,6}\s+\S"))


def only_numbering(text: Column) -> Column:
    """ST38."""
    return F.rlike(text, F.lit(r"^\s*\d+(?:\.\d+)*\.?\s*$"))


def without_page(text: Column) -> Column:
    """ST38: trailing dots and page number go."""
    return F.rtrim(_sub(text, r"[\s.·…]*\s\d+\s*$"))


def caption_number(text: Column) -> Column:
    """ST40: the number of a figure caption, else empty."""
    return F.regexp_extract(text, r"(?i)^\s*(?:图|figure|fig\.?)\s*(\d+(?:[-.]\d+)*)", 1)


def clean_body(text: Column) -> Column:
    """ST41: images, addresses, paths and file names go, blank lines collapse."""
    out = _sub(text, r"!\[[^\]]*\]\([^)]*\)")
    out = _sub(out, r"https?://[^\s)>]+")
    out = _sub(out, r"(?:[A-Za-z]:)?[\\/](?:[\w.-]+[\\/])+[\w.-]+")
    out = _sub(out, r"\b[\w-]+\.(?:png|jpe?g|gif|svg|webp|pdf)\b")
    return F.trim(_sub(out, r"\n{3,}", "\n\n"))


def is_remote(path: Column) -> Column:
    """ST42."""
    return F.rlike(path, F.lit(r"(?i)^(?:https?:)?//|^data:"))


def local_path(path: Column) -> Column:
    """ST42: separators and leading dots normalised, escapes decoded."""
    return F.url_decode(_sub(_sub(path, r"\\", "/"), r"^(?:\./)+"))


def first_line(text: Column) -> Column:
    """ST47: the first line of model output, unquoted, without spaces outside or inside the quotes."""
    line = F.trim(F.get(F.split(F.trim(text), "\n"), 0))
    return F.trim(_sub(line, "^[\"'“”‘’]+|[\"'“”‘’]+$"))


def sentences(text: Column) -> Column:
    """ST48."""
    return F.filter(F.transform(F.split(text, r"[?？!！。；;\n]"), lambda x: F.trim(x)), lambda x: x != "")


def calendar_text(text: Column) -> Column:
    """ST49: wide spaces and curly quotes become plain, spaces between ideographs go."""
    plain = F.translate(text, "　“”‘’", " \"\"''")
    return F.trim(_sub(plain, f"(?<=[{CJK}])\\s+(?=[{CJK}])"))


#: A12: terms that have to be whole words.
PLAIN_TERM = "^[a-z0-9]+$"


def padded_words(text: Column) -> Column:
    """A12: the words of a text in lower case, each between spaces of its own; ideographs are word characters."""
    return F.concat(F.lit(" "), _sub(F.lower(text), r"[^\p{L}\p{N}_]+", "  "), F.lit(" "))


def word_or_substring(query: Column, term: Column) -> Column:
    """A12: a term of a-z0-9 has to be a whole word (ideographs are word characters), any other a substring."""
    q, t = F.lower(query), F.lower(term)
    plain = F.rlike(t, F.lit(PLAIN_TERM))
    whole = F.contains(padded_words(query), F.concat(F.lit(" "), t, F.lit(" ")))
    return (t != "") & (q != "") & F.when(plain, whole).otherwise(F.contains(q, t))


def shortened(text: Column, most: int) -> Column:
    """PRJ4."""
    flat = _sub(text, r"\n+", " ")
    return F.when(F.char_length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def fixed_pieces(text: Column, size: int, overlap: int) -> Column:
    """MX16: pieces of ``size`` characters, each beginning ``overlap`` before the end of the last; one at least."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(text) - overlap), F.lit(size - overlap))
    return F.transform(starts, lambda at: F.substr(text, at, F.lit(size)))
