"""Rules that SQL can't express, or that the tables don't show, by example and against plain Python."""

import json
import re

import pytest
from pyspark.sql import functions as F

from lorewright.functions import calendar as C
from lorewright.functions import tex
from lorewright.functions import text as T
from lorewright.operators import records as P
from lorewright.scratch import Scratch
from lorewright.sources import readers as R
from lorewright.sources import sinks as S


def column(spark, rule, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [r.out for r in df.select("i", rule(F.col("t")).alias("out")).orderBy("i").collect()]


def test_spoken_parts_and_choices(spark):
    parts = {
        "第一问量角度。第二问画图形": "(1)量角度。\n\n(2)画图形",
        "$，第一小问：求周期。": "$，(1)：求周期。",
        "问题 ２、求和": "(2)求和",
        "没有小题": "没有小题",
        "": "",
    }
    assert column(spark, T.numbered_parts, parts) == list(parts.values())
    choices = {
        "下列说法正确的是 选项A 一 选项b：二": "下列说法正确的是\nA. 一\nB. 二",
        "若x>0，则，选项A正 选项B反 C选项 三 选项$D$四": "若x>0，则：\nA. 正\nB. 反\nC. 三\nD. 四",
        "选项A 只有一个": "选项A 只有一个",
        "单选题没有标记": "单选题没有标记",
    }
    assert column(spark, T.choice_lines, choices) == list(choices.values())
    assert column(spark, T.clean_output, ["<think>x</think>```\n输出：'第一问求和'\n```"]) == ["(1)求和"]


def test_words_of_questions_are_parameters(spark):
    texts = {"正方体的棱长": True, "高中生活": False, "圆的面积": True, "解方程": True, "请求帮助": False, "求证两边相等": True, "计算机": False, "": False, "hello": False}
    assert column(spark, T.is_math_problem, texts) == list(texts.values())
    assert column(spark, lambda t: T.is_math_problem(t, ("计算(?!机)", "^hello$")), ["计算和", "计算机", " hello ", "hello you"]) == [True, False, True, False]
    context = {"这个怎么算": True, "什么是这个": False, "看，定理，它": False, "Big Apple 这个": False, "": False, "它" + "长" * 30: False, "没有": False}
    assert column(spark, T.depends_on_context, context) == list(context.values())
    assert column(spark, lambda t: T.depends_on_context(t, ("that",), ("what",)), ["and that", "what that", "no"]) == [True, False, False]
    concepts = {"课本里的定义": True, "什么是圆": False, "教材": False, "概念" + "长" * 23: True, "长" * 40: False}
    assert column(spark, T.explains_concept, concepts) == list(concepts.values())


def test_places(spark):
    weather = {
        "请问北京今天天气": "北京", "成都的天气怎么样": "成都", "what's the weather like in New York today": "New York", "weather of San Francisco Tomorrow": "San Francisco",
        "London天气": "London", "会不会冷": "会不会冷", "plain": None, "": None,
    }
    assert column(spark, T.weather_place, weather) == list(weather.values())
    traffic = {"成都堵不堵": "成都", "请问上海今天路况": "上海", "堵不堵": None, "Rome 交通": "Rome", "": None}
    assert column(spark, T.traffic_place, traffic) == list(traffic.values())


def test_conversion_logs(spark):
    rows = {
        "12:00 ASR→LaTeX: duration=1.00s, before='a, b', after='c'": ("ASR→LaTeX", "1.00s", "a, b", "c"),
        "x ASR→LaTeX after classification: before=a, after='b, duration=2s": ("ASR→LaTeX after classification", "2s", "a", "b"),
        "something else": None,
        "ASR→LaTeX decision": None,
    }
    assert [r and tuple(r) for r in column(spark, T.conversion_log, rows)] == list(rows.values())


def test_found_dates(spark):
    texts = ["on 2024-01-05 x", "2024/11/28", "2024年2月30日 2024-01-01", "2024年3月15日", "id 20240405 x", "2024/0406", "3月7日", "1999-01-01", "2024-13-40", ""]
    found = lambda **how: [str(x) if x else None for x in column(spark, lambda t: C.found_date(t, F.lit("2025-06-01").cast("date"), **how), texts)]
    assert found() == ["2024-01-05", "2024-11-02", "2024-01-01", "2024-03-15", "2024-04-05", "2024-04-06", "2025-03-07", None, None, None]
    assert found(as_written=False) == ["2024-01-05", "2024-11-28", "2024-01-01", "2024-03-15", "2024-04-05", "2024-04-06", "2025-03-07", None, None, None]


def test_records_from_json(spark):
    assert column(spark, P.json_objects, ['a {"x": {"y": 1}} {"z": "}"} {bad', "", None]) == [['{"x": {"y": 1}}', '{"z": "}"}'], [], []]
    assert column(spark, P.flat_text, ['{"content": ["a", {"content": " b "}]}', "plain", None]) == ["a b", "plain", None]
    assert json.loads(column(spark, R.nested_json, ['{"a": "[1, \\"{\\\\\\"b\\\\\\": 2}\\"]"}'])[0]) == {"a": [1, {"b": 2}]}


def test_formulas_put_aside(spark):
    texts = ["$a$ and $$b$$ tail", "none", None, r"\$5 and $x$"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", tex.set_aside("t").alias("r")).orderBy("i").collect()
    assert [(r.r.n, r.r.first) for r in rows] == [(2, "$a$"), (0, None), (0, None), (1, "$x$")]


def test_strict_readers_and_the_one_file(spark):
    scratch = Scratch(spark, "t")
    spark.createDataFrame([('{"a": 1}',), ("{bad",)], "value string").coalesce(1).write.text(scratch.path("rows"))
    assert R.jsonl(spark, scratch.path("rows"), "a int").count() == 1
    with pytest.raises(Exception):
        R.jsonl(spark, scratch.path("rows"), "a int", strict=True).collect()
    lines = R.file_lines(spark, scratch.path("rows")).orderBy("line_no").collect()
    assert [r.line_no for r in lines] == [1, 2]
    for _ in range(2):
        spark.range(1).selectExpr("string(id) value").write.mode("append").text(scratch.path("many"))
    for pattern in (r"\.txt$", "nothing"):
        with pytest.raises(ValueError):
            R.the_one_file(spark, scratch.path("many"), pattern)


def test_lines_of_a_file_in_many_blocks(spark):
    scratch = Scratch(spark, "t")
    n = 5000
    spark.range(n).coalesce(1).selectExpr("concat(id, repeat('x', int(id % 50))) value").write.text(scratch.path("rows"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = R.file_lines(spark, scratch.path("rows"))
        assert got.rdd.getNumPartitions() >= 1
        assert {(r.line_no - 1, int(re.match(r"\d+", r.line)[0])) for r in got.collect()} == {(i, i) for i in range(n)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pretty_json_is_json(spark):
    scratch = Scratch(spark, "t")
    S.write_pretty(spark.createDataFrame([(1, "ü", ["a"])], "id int, name string, tags array<string>"), scratch.path("rows"))
    texts = [r.value for r in spark.read.text(scratch.path("rows"), wholetext=True).collect()]
    assert len(texts) == 1 and json.loads(texts[0]) == {"id": 1, "name": "ü", "tags": ["a"]} and "\n" in texts[0].strip()


def test_traffic_places_read_a_text_once(spark):
    import random
    import re

    from pyspark.sql import functions as F

    def plain(t):
        q = t.strip(" ")
        m = re.search("([一-鿿A-Za-z]{2,20})(?:堵不堵|拥堵|路况|交通)", q)
        bare = re.sub("(?:今天|今日|现在)$", "", re.sub("^(?:请问|我想了解一下|想了解一下|帮我查一下|查一下|今天|今日|现在)", "", m[1] if m else "")).strip(" ")
        rest = re.sub("堵不堵|拥堵|路况|交通|今天|今日|现在", "", re.sub("[^一-鿿A-Za-z]", "", q))
        return bare or (rest if 2 <= len(rest) <= 20 else None)

    rnd, parts = random.Random(5), ["堵不堵", "拥堵", "路况", "交通", "今天", "请问", "查一下", "堵", "不", "成都", "a", "Bc", " ", "。", "1", "\n", "😀", "日", "long words "]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, n))) for n in (2, 4, 8, 30, 60) for _ in range(120)] + ["a" * n + "1今天" * m for n in (20, 21, 22) for m in (0, 3, 40)]
    assert column(spark, T.traffic_place, texts) == [plain(t) for t in texts]
    assert str(T.traffic_place(F.col("the_text"))).count("the_text") == 1  # however dear the text, it is made once
