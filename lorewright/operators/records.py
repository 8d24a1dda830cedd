"""Projections and record rules (PRJ1-PRJ15, FIL8-FIL18, SUP3-SUP34)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def enabled_ids(datasets: Column) -> Column:
    """PRJ1: ids of the enabled entries of an array of (id, enabled) structs, as strings."""
    return F.transform(F.filter(datasets, lambda d: d["enabled"] == 1), lambda d: d["id"].cast("string"))


def preview(text: Column, most: int = 120) -> Column:
    """PRJ3: the beginning and the length."""
    return F.struct(F.substring(text, 1, most).alias("head"), F.char_length(text).alias("n_chars"))


def page_range(start: Column, end: Column) -> Column:
    """PRJ6: pages from start to end; empty where there is no start."""
    return F.when((start > 0) & (end >= start), F.sequence(start, end)).otherwise(F.array().cast("array<long>"))


def qa_chunks(books: DataFrame, key: str) -> DataFrame:
    """PRJ7: one chunk for each non-empty question and answer, with a running index.

    ``chapters array<struct<title, sections array<struct<title, qa array<struct<question, answer>>>>>>``.
    """
    c = books.select(key, F.posexplode("chapters").alias("c", "chapter"))
    s = c.select(key, "c", F.col("chapter.title").alias("chapter"), F.posexplode("chapter.sections").alias("s", "section"))
    q = s.select(key, "c", "s", "chapter", F.col("section.title").alias("section"), F.posexplode("section.qa").alias("q", "qa"))
    q = q.where((F.trim(F.coalesce("qa.question", F.lit(""))) != "") & (F.trim(F.coalesce("qa.answer", F.lit(""))) != ""))
    index = (F.row_number().over(Window.partitionBy(key).orderBy("c", "s", "q")) - 1).cast("long")
    return q.select(key, index.alias("chunk_index"), F.array("chapter", "section").alias("title_path"), F.concat_ws("\n", "qa.question", "qa.answer").alias("content"))


def embedding_text(path: Column, content: Column) -> Column:
    """PRJ9: the title path before the content."""
    prefix = F.concat_ws(" > ", path)
    return F.when(prefix == "", content).otherwise(F.concat(prefix, F.lit("\n\n"), content))


def index_text(name: Column, word: Column, similar: Column) -> Column:
    """PRJ10."""
    return F.concat_ws(" ", name, word, F.array_join(similar, " "))


def job_markdown(content: Column) -> Column:
    """PRJ11: of each item its text, else its content, joined."""
    return F.array_join(F.transform(content, lambda x: F.coalesce(F.nullif(x["text"], F.lit("")), x["content"], F.lit(""))), "")


def source_snippet(text: Column, most: int = 200) -> Column:
    """PRJ12."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def concept_name(name: Column, title: Column, body: Column, file: Column) -> Column:
    """PRJ13: name, else title, else the first heading of the body, else the file's name."""
    heading = F.regexp_extract(body, r"(?m)^[ \t]*#[ \t]+(.+?)[ \t]*$", 1)
    stem = F.regexp_replace(F.regexp_replace(file, r"^.*/", ""), r"\.[^.]*$", "")
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in (name, title, heading, stem)])


def comma_joined(values: Column) -> Column:
    """PRJ14."""
    return F.coalesce(F.array_join(values, ","), F.lit(""))


def selected_chunks(chunks: DataFrame, fields: list[str], title: str | None, offset: int, most: int | None, order: list[Column]) -> DataFrame:
    """FIL10: extractable chunks, by a case-insensitive part of any field, from an offset on."""
    rows = chunks.where("extractable")
    if title:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(title.lower())))
    rows = rows.orderBy(*order).offset(offset)
    return rows.limit(most) if most is not None else rows


def plain_entity(name: Column, low: int = 2, high: int = 8) -> Column:
    """FIL11: a name without digits, signs, formulas or paths, of two to eight characters."""
    return F.char_length(name).between(low, high) & ~F.rlike(name, F.lit(r"[0-9\s$\\/_=+*^<>(){}\[\]|#@&%~`.,;:!?'\"-]"))


def cross_language(text_language: Column, wanted: Column) -> Column:
    """FIL15: whether a history row may stay: undetermined, or in the wanted language."""
    return (text_language == "") | (text_language == wanted)


def any_true(*flags: Column) -> Column:
    """FIL18: true in any of several places, nulls are not."""
    out = F.lit(False)
    for f in flags:
        out = out | F.coalesce(f, F.lit(False))
    return out


def first_seen(rows: DataFrame, name: str, pos: str) -> DataFrame:
    """SUP14: distinct non-empty names in the order in which they come."""
    return rows.where(F.trim(name) != "").groupBy(name).agg(F.min(pos).alias("pos"))


def weather_row(*parts: tuple[str, Column]) -> Column:
    """SUP4: labelled fields as a text; missing ones are left out."""
    return F.concat_ws(", ", *[F.when(v.isNotNull(), F.concat(F.lit(f"{k} "), v.cast("string"))) for k, v in parts])


def document_detail(docs: DataFrame, kb: DataFrame, chunks: DataFrame) -> DataFrame:
    """SUP5: documents with their knowledge base and chunk statistics."""
    stats = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.char_length("content")).alias("n_content"))
    out = docs.join(kb, "kb_id", "left").join(stats, "doc_id", "left")
    return out.withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0).cast("long"))).withColumn("n_content", F.coalesce("n_content", F.lit(0).cast("long")))


def numbered_names(files: DataFrame, name: str, ext: str, file: str) -> DataFrame:
    """SUP31: new names; of several with one name and extension, the second and later get _1, _2 ..."""
    w = Window.partitionBy(name, ext)
    at = F.row_number().over(w.orderBy(file)) - 1
    new = F.when(at > 0, F.concat(F.col(name), F.lit("_"), at.cast("string"))).otherwise(F.col(name))
    return files.select(file, F.concat(new, F.lit("."), F.col(ext)).alias("new_name"))


def payload_text(chunk: Column) -> Column:
    """SUP32: the text of a streamed JSON chunk, else empty."""
    return F.coalesce(F.get_json_object(chunk, "$.choices[0].delta.content"), F.lit(""))


def last_user_message(messages: Column) -> Column:
    """SUP33: the last user message, else the last message, else empty."""
    mine = F.filter(messages, lambda m: m["role"] == "user")
    return F.coalesce(F.try_element_at(mine, F.lit(-1))["content"], F.try_element_at(messages, F.lit(-1))["content"], F.lit(""))


def last_user_messages(messages: DataFrame, key: str, order: list[str], role: str, text: str) -> DataFrame:
    """SUP33 over rows: each key's last user message, else its last message, else empty; one row is kept by key and task."""
    at = F.struct(*order)
    mine = F.max_by(F.when(F.col(role) == "user", F.col(text)), F.when(F.col(role) == "user", at))
    return messages.groupBy(key).agg(F.coalesce(mine, F.max_by(text, at), F.lit("")).alias("message"))


def latest_runs(runs: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """SUP26: the latest completed run of each key."""
    done = runs.where("status = 'completed'")
    return done.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select(*keys, "r.*")


def id_strings(ids: Column) -> Column:
    """PRJ2: ids as strings, nulls left out."""
    return F.transform(F.array_compact(ids), lambda x: x.cast("string"))


def field_of(structs: Column, name: str) -> Column:
    """PRJ2: one field of an array of structs, null structs left out."""
    return F.transform(F.array_compact(structs), lambda x: x[name])


def script_chunks(rows: DataFrame, section: str, questions: str, script: str) -> DataFrame:
    """PRJ8: title, content: one chunk for each question, or one titled by the section."""
    titles = F.when(F.size(questions) > 0, F.col(questions)).otherwise(F.array(section))
    out = rows.withColumn("title", F.explode(titles))
    return out.withColumn("content", F.concat_ws("\n", "title", script)).drop(section, questions, script)


def custom_kg(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PRJ15: (id, name, source) to chunks (entity, id) and entities with their distinct sources."""
    chunks = records.select(F.trim("name").alias("entity"), "id", "source")
    return chunks, chunks.groupBy("entity").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def first_text(*values: Column) -> Column:
    """The first text that is not blank, trimmed; empty if all are."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values], F.lit(""))


def plain_type(value: Column) -> Column:
    """SUP23."""
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def with_content(rows: DataFrame, fields: list[str], files: DataFrame, file: str, text: str) -> DataFrame:
    """SUP13: ``resolved``: the first of the fields that has a text, else the file's."""
    own = F.nullif(first_text(*map(F.col, fields)), F.lit(""))
    return rows.join(files.select(file, text), file, "left").withColumn("resolved", F.coalesce(own, F.col(text), F.lit("")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_objects(texts: pd.Series) -> pd.Series:
    """MX9: the JSON objects of a text in order, as text; what does not parse is passed over."""
    decoder = json.JSONDecoder()

    def find(text: str | None) -> list[str]:
        out, at, text = [], 0, text or ""
        while (at := text.find("{", at)) >= 0:
            try:
                _, end = decoder.raw_decode(text, at)
            except ValueError:
                at += 1
                continue
            out.append(text[at:end])
            at = end
        return out

    return texts.map(find)


def _texts(value) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return [t for v in value for t in _texts(v)]
    return _texts(value["content"]) if isinstance(value, dict) and value.get("content") is not None else []


@F.pandas_udf(T.StringType())
def flat_text(texts: pd.Series) -> pd.Series:
    """SUP21: the texts of nested contents, given as JSON, in order with one space between."""
    def one(text: str) -> str:
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        return " ".join(t.strip() for t in _texts(value) if t.strip())

    return texts.map(one, na_action="ignore")
