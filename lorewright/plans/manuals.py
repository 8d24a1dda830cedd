"""Captions, Markdown lines and semantic pieces of manuals, over ``documents``, ``part`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import captions as C
from ..operators.semantic import semantic_pieces
from ..session import table
from ..sources.markdown_table import markdown_lines
from .registry import query


@query(r"""
with t as (select doc_id, replace(replace(coalesce(text, ''), chr(10), ' '), '图', '') as t from documents),
r as (select doc_id, case doc_id % 10 when 0 then '图 3 － 12 ' || t when 1 then t || ' 作者： someone' when 2 then ' Image ' when 3 then t || '.png' when 4 then md5(t) when 5 then '图2-1'
    when 6 then '图 2 - 1  。-' || t || ',,;' when 7 then t || ' (Author: me)' when 8 then '截图' else 'see https://x/' || t end as raw from t),
n as (select doc_id, raw, replace(regexp_replace(regexp_extract(raw, '^\s*(图\s*\d+\s*[-－]\s*\d+)', 1), '\s+', '', 'g'), '－', '-') as number, regexp_replace(raw, '^\s*(图\s*\d+\s*[-－]\s*\d+)', '') as rest from r),
c as (select doc_id, raw, number, trim(regexp_replace(regexp_replace(regexp_replace(rest, '\s*作者\s*[:：].*$', ''), '(?i)(\s+|^|([^A-Za-z\s]))(author\s*[:：]|by\s+).*$', '\2'), '\s+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13) || '-—:：;,，。') as text from n),
d as (select doc_id, raw, nullif(number, '') as figure, case when text <> '' and lower(text) not in ('无图注', 'image', 'img', '图片', '图像', 'photo', 'picture', 'screenshot', '截图') then text end as caption from c)
select doc_id, figure, md5(caption) as caption_md5, md5(case when not regexp_matches(lower(trim(raw)), '^[0-9a-f]{8,}$') and not regexp_matches(lower(trim(raw)), 'images/|https?://|\.(?:jpe?g|png|webp)(?:\b|$)') then caption end) as alt_md5,
    md5(coalesce(regexp_replace(lower(caption), '[^0-9a-z一-鿿]+', '', 'g'), '')) as key_md5 from d
""")
def st40_captions(spark, sf_dir):
    """Captions made of every document's whole text: figure number, text, what alternative text says, and the key to compare by (ST40)."""
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("图"), F.lit(""))
    forms = {
        0: F.concat(F.lit("图 3 － 12 "), text), 1: F.concat(text, F.lit(" 作者： someone")), 2: F.lit(" Image "), 3: F.concat(text, F.lit(".png")), 4: F.md5(text), 5: F.lit("图2-1"),
        6: F.concat(F.lit("图 2 - 1  。-"), text, F.lit(",,;")), 7: F.concat(text, F.lit(" (Author: me)")), 8: F.lit("截图"), 9: F.concat(F.lit("see https://x/"), text),
    }
    raw = F.coalesce(*[F.when(F.col("doc_id") % 10 == k, v) for k, v in forms.items()])
    rows = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    r = F.col("raw")
    return rows.select("doc_id", C.figure_number(r).alias("figure"), F.md5(C.caption_text(r)).alias("caption_md5"), F.md5(C.meaningful_alt(r)).alias("alt_md5"), F.md5(C.compare_key(r)).alias("key_md5"))


@query(r"""
with k as (select p_partkey, regexp_replace(lower(p_name || ' of ' || p_type), '[^0-9a-z]+', '', 'g') as key, p_partkey % 6 as k from part)
select p_partkey, key <> '' and case k when 0 then true when 1 then length(key) >= 8 when 2 then length(key) >= 8 and (length(key) - 1) / length(key) >= 0.92 when 3 then false when 4 then false else true end as matches from k
""")
def st40_caption_matches(spark, sf_dir):
    """Lines that repeat a caption: the same, one that goes on, one with a letter changed, another one, none (ST40, JN14)."""
    name, k = F.concat("p_name", F.lit(" of "), "p_type"), F.col("p_partkey") % 6
    line = (
        F.when(k == 0, F.concat(F.lit("图1-2 "), F.upper(name))).when(k == 1, F.concat(name, F.lit(" 续"), name)).when(k == 2, F.concat(F.lit("7"), F.substring(name, 2, 1000)))
        .when(k == 3, "unlike").when(k == 4, "图片").otherwise(F.concat(name, F.lit(" by some hand")))
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", C.compare_key(name).alias("a"), C.compare_key(line).alias("b"))
    return rows.select("p_partkey", C.captions_match(F.col("a"), F.col("b")).alias("matches"))


@query("""
with s as (select vec_id // 40 as doc, vec_id as seq, embedding::double[] as v, 20 + vec_id * 37 % 120 as chars from embeddings),
w as (select *, list(v) over (partition by doc order by seq rows between 3 preceding and 1 preceding) as a, list(v) over (partition by doc order by seq rows between current row and 2 following) as b from s),
m as (select doc, seq, chars, case when len(a) > 0 then list_cosine_similarity([list_sum([x[i] for x in a]) for i in range(1, 65)], [list_sum([x[i] for x in b]) for i in range(1, 65)]) end as c from w),
n as (select *, case when c < 0.75 and c <= coalesce(lag(c) over o, 2) and c < coalesce(lead(c) over o, 2) then 1 else 0 end as ch from m window o as (partition by doc order by seq)),
x as (select *, sum(ch) over (partition by doc order by seq) as matter from n),
y as (select *, case when ch = 1 and sum(chars) over (partition by doc, matter) >= 100 then 1 else 0 end as opens from x),
z as (select *, sum(opens) over (partition by doc order by seq) as piece from y)
select doc, seq, piece::bigint as piece, (coalesce(sum(chars) over (partition by doc, piece order by seq rows between unbounded preceding and 1 preceding), 0) // 500)::bigint as part from z
""")
def mx16_semantic_pieces(spark, sf_dir):
    """Forty vectors each as the sentences of a document, cut where the matter changes (MX16)."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 40).alias("doc"), F.col("vec_id").alias("seq"), "embedding", (20 + F.col("vec_id") * 37 % 120).alias("chars")
    )
    return semantic_pieces(rows, "doc", "seq", "embedding", "chars").select("doc", "seq", "piece", "part")


@query(r"""
with t as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
e as (select doc_id, generate_subscripts(l, 1) as n, unnest(l) as s from t),
m as (select doc_id, n, case when n % 3 = 0 then '![pic](./a b' || n || '.png' when n % 5 = 0 then '![one](x' || n || '.png) ' || s || ' ![](<y z.jpg>)' else s end as s from e),
i as (select doc_id, n, s, length(trim(s, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) = 0 as blank from m),
u as (select *, min(case when blank then n end) over (partition by doc_id order by n rows between 1 following and unbounded following) as next_blank, max(n) over (partition by doc_id) as last from i)
select doc_id, count(*) + count(*) filter (n % 3 <> 0 and n % 5 = 0) as n_rows, count(*) filter (n % 3 <> 0 and n % 5 = 0) * 2 as n_images, max(n) as n_lines,
    sum(case when blank then n else coalesce(next_blank - 1, last) end * case when n % 3 <> 0 and n % 5 = 0 then 2 else 1 end)::bigint as ends,
    coalesce(string_agg(case when n % 3 <> 0 and n % 5 = 0 then 'x' || n || '.png,y z.jpg' end, ',' order by n), '') as paths from u group by doc_id
""")
def src10_markdown_lines(spark, sf_dir):
    """Numbered lines, images and paragraph ends of every document, by a table function called laterally (SRC10, SUP22)."""
    lines = F.transform(
        F.split(F.coalesce("text", F.lit("")), "\n", -1),
        lambda s, i: F.when((i + 1) % 3 == 0, F.concat(F.lit("![pic](./a b"), (i + 1).cast("string"), F.lit(".png")))
        .when((i + 1) % 5 == 0, F.concat(F.lit("![one](x"), (i + 1).cast("string"), F.lit(".png) "), s, F.lit(" ![](<y z.jpg>)")))
        .otherwise(s),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))
    rows = docs.lateralJoin(markdown_lines(F.col("text").outer()))
    paths = F.array_sort(F.collect_list(F.when(F.col("image_path").isNotNull(), F.struct("line_no", "image_path"))))  # of one document
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("image_path").alias("n_images"), F.max("line_no").alias("n_lines"), F.sum("until").alias("ends"),
        F.array_join(F.transform(paths, lambda x: x["image_path"]), ",").alias("paths"),
    )
