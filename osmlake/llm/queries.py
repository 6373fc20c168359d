"""The queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from osmlake.llm import bpe, bytecnn, chattree, decontaminate, deleted, mil, ogg, simhash, substring, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents"))


def op4_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.decode_media(ogg.encode_media(table(spark, sf_dir, "documents")))


def op5_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted.score(table(spark, sf_dir, "documents"))


def op7_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    own = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    return chattree.round_trip(conversations.select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(own, "conv_id long, turn long, role string, text string")))


def op10_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytecnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_byte_bpe, op2_warc_zstd, op3_substring_dedup, op4_ogg_media, op5_toxicity_mil, op6_deleted_interpolation, op7_simhash_pivots, op8_decontamination, op9_chat_prefix_tree, op10_quality_cnn)
}

#: SQL for op8: the windows of items joined with all word runs of the same length of the documents.
OP8_SQL = r"""
with d as (select doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') w from documents),
b as (select item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') w from benchmark),
bw as (select item_id, least(len(w), 13) size, list_aggregate(w[i:i + least(len(w), 13) - 1], 'string_agg', ' ') win
       from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i from b where len(w) > 0)),
sizes as (select distinct size from bw),
dw as (select doc_id, i, size, list_aggregate(w[i:i + size - 1], 'string_agg', ' ') win
       from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) i from d, sizes where len(w) >= size)),
hit as (select dw.doc_id, dw.i, dw.size, bw.item_id from dw join bw using (size, win)),
covered as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + size)) p from hit) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) ids from (select distinct doc_id, cast(item_id as varchar) item from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(ids, '')) items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join covered using (doc_id) left join items using (doc_id)
"""

#: SQL for op2: digests, and the largest page of equal payloads as response.
OP2_SQL = """
with p as (select page_id, coalesce(html, '') h from pages),
s as (select page_id, cast(octet_length(encode(h)) as bigint) n, sha1(h) x, max(page_id) over (partition by h) resp from p),
bits as (select page_id, n, resp, list_aggregate(list_transform(range(1, 41), lambda k: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', substr(x, k, 1)) - 3, 4)), 'string_agg', '') b from s)
select page_id, n payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
           + 16 * cast(substr(b, cast(5 * i + 1 as bigint), 1) as integer) + 8 * cast(substr(b, cast(5 * i + 2 as bigint), 1) as integer) + 4 * cast(substr(b, cast(5 * i + 3 as bigint), 1) as integer)
           + 2 * cast(substr(b, cast(5 * i + 4 as bigint), 1) as integer) + cast(substr(b, cast(5 * i + 5 as bigint), 1) as integer), 1)), 'string_agg', '') payload_digest,
       case when resp <> page_id then 'revisit' else 'response' end record_type, case when resp <> page_id then resp end refers_to
from bits
"""

#: SQL for op3: every window with where it first starts.
OP3_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
win as (select doc_id, i, list_aggregate(w[i:i + 19], 'string_agg', ' ') s from (select doc_id, w, unnest(range(1, len(w) - 18)) i from d where len(w) >= 20)),
ranked as (select doc_id, i, row_number() over (partition by s order by doc_id, i) k from win),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 20)) p from ranked where k > 1)),
word as (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) p from d),
kept as (select word.doc_id, string_agg(x, ' ' order by p) t from word anti join gone on word.doc_id = gone.doc_id and word.p = gone.p group by word.doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(g.n, 0) as bigint) n_removed, sha256(coalesce(kept.t, '')) kept_sha256
from d left join (select doc_id, count(*) n from gone group by doc_id) g using (doc_id) left join kept using (doc_id)
"""

_ESCAPE = "replace({0}, '\\', '\\\\')"
for _control in chattree.CONTROLS:
    _ESCAPE = f"replace({_ESCAPE}, '{_control}', '{_control[0]}\\{_control[1:]}')"

#: SQL for op9: turns in order, the template's length for each, and the assistant's texts.
OP9_SQL = f"""
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
           union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select cast(conv_id as bigint) conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) turns_sha256,
       cast(sum(case when r = 'assistant' then length(t) else 0 end) as bigint) loss_chars,
       sha256(string_agg(case when r = 'assistant' then t else '' end, '' order by turn, r, t)) loss_sha256,
       cast(sum(length({_ESCAPE.format("t")}) + case r when 'user' then 16 when 'assistant' then 4 else 17 + length({_ESCAPE.format("r")}) end) as bigint) formatted_chars
from c group by conv_id
"""

ORACLE_SQL: dict[str, str] = {"op2_warc_zstd": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op8_decontamination": OP8_SQL, "op9_chat_prefix_tree": OP9_SQL}
