"""Conversations: formatting, masks, packing, prompts and serving rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import END, stop_place
from tessera.operators import bpe, chat, ordering
from tessera.plans.base import SPECIAL_ROWS, query, table
from tessera.plans.metrics import ids_of
from tessera.sources import files

LENGTH, PACKED = 512, 128

_BYTES = "list_transform(regexp_extract_all(hex(encode({})), '..'), lambda x: ('0x' || x)::INT)"
_SFT = f"""seg AS (SELECT conv_id, turn, list_append(list_prepend(s.id, {_BYTES.format('text')}), 256) AS ids, role = 'assistant' AS says FROM conversations JOIN {SPECIAL_ROWS} ON s.txt = '<|' || role || '|>'),
sft AS (SELECT conv_id, flatten(list(ids ORDER BY turn))[1:{LENGTH}] AS ids, flatten(list(list_transform(ids, lambda x, i: CASE WHEN says AND i > 1 THEN 1 ELSE 0 END) ORDER BY turn))[1:{LENGTH}] AS mask FROM seg GROUP BY conv_id)"""


def _examples(spark, d, length=LENGTH):
    """Encoded with the bytes and specials alone."""
    return chat.format_examples(table(spark, d, "conversations"), [], bpe.vocabulary(spark, []), length)


@query(f"WITH {_SFT} SELECT conv_id, ids FROM sft")
def sft_format(spark, d):
    return _examples(spark, d).select("conv_id", "ids")


@query(f"WITH {_SFT} SELECT conv_id, mask, list_sum(mask)::BIGINT AS n_response FROM sft")
def sft_mask(spark, d):
    return _examples(spark, d).select("conv_id", "mask", F.aggregate("mask", F.lit(0).cast("long"), lambda s, x: s + x).alias("n_response"))


_PAD = f"""n AS (SELECT conv_id, ids[1:{PACKED}] AS ids, mask[1:{PACKED}] AS mask FROM sft), m AS (SELECT *, CASE WHEN len(ids) < 2 THEN 0 ELSE len(ids) - 1 END AS k FROM n)
SELECT conv_id, list_concat(ids[1:k], list_transform(range(0, {PACKED - 1} - k), lambda x: 256)) AS input_ids, list_concat(ids[2:k + 1], list_transform(range(0, {PACKED - 1} - k), lambda x: 256)) AS target_ids,
list_transform(list_concat(mask[2:k + 1], list_transform(range(0, {PACKED - 1} - k), lambda x: 0)), lambda x: x::DOUBLE) AS loss_mask, list_transform(range(0, {PACKED - 1}), lambda x: x < k) AS attention_mask FROM m"""


@query(f"WITH {_SFT}, {_PAD}")
def sft_pack(spark, d):
    return chat.pad_and_shift(_examples(spark, d), PACKED, 256)


@query(f"WITH {_SFT} SELECT conv_id, list_sum(mask)::BIGINT AS n_response FROM sft WHERE list_sum(mask) >= 16")
def sft_filter_short(spark, d):
    return sft_mask(spark, d).where("n_response >= 16").select("conv_id", "n_response")


@query(f"WITH {_SFT} SELECT count(*)::BIGINT AS seen, count_if(list_sum(mask) >= 16)::BIGINT AS kept, count_if(list_sum(mask) < 16)::BIGINT AS too_short, round(avg(list_sum(mask)) FILTER (list_sum(mask) >= 16), 6) AS mean_response, count_if(list_sum(mask) < 16) > 0.5 * count(*) AS warn FROM sft")
def sft_build_stats(spark, d):
    m = sft_mask(spark, d)
    short = F.count_if(F.col("n_response") < 16)
    return m.agg(F.count("*").alias("seen"), F.count_if(F.col("n_response") >= 16).alias("kept"), short.alias("too_short"), F.round(F.avg(F.when(F.col("n_response") >= 16, F.col("n_response"))), 6).alias("mean_response"), (short > 0.5 * F.count("*")).alias("warn"))


@query(f"WITH {_SFT}, kept AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS rn FROM sft WHERE list_sum(mask) >= 16) SELECT conv_id FROM kept WHERE rn < 50")
def sft_cap_examples(spark, d):
    """The first 50 examples that are long enough."""
    return ordering.ranked(sft_mask(spark, d).where("n_response >= 16").select("conv_id"), "conv_id").where("rn < 50").select("conv_id")


_STRIP = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"
# the second line of each document stands for a marker's line
_BLOCKS = f"""l AS (SELECT doc_id AS block, i - 1 AS line_no, CASE WHEN i = 2 THEN '  Story: ' || l[i] ELSE l[i] END AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) u(i)),
s AS (SELECT block, line_no, CASE WHEN line_no = 1 THEN {_STRIP.format("substr(ltrim(line), 7)")} ELSE line END AS line, (SELECT max(line_no) FROM l m WHERE m.block = l.block AND line_no = 1) AS led FROM l)"""
_PARSED = f"""{_BLOCKS}, p AS (SELECT block, nullif({_STRIP.format("coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (line_no < led AND trim(line) <> ''), '')")}, '') AS prompt, nullif({_STRIP.format("coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (line_no >= led AND trim(line) <> ''), '')")}, '') AS story FROM s GROUP BY block)"""


def _story_lines(spark, d):
    rows = files.lines(table(spark, d, "documents"))
    return rows.select(F.col("doc_id").alias("block"), "line_no", F.when(F.col("line_no") == 1, F.concat(F.lit("  Story: "), "line")).otherwise(F.col("line")).alias("line"))


@query(f"WITH {_PARSED} SELECT block, prompt, story FROM p WHERE prompt IS NOT NULL AND story IS NOT NULL")
def sft_parse_blocks(spark, d):
    return chat.parse_blocks(_story_lines(spark, d)).where("prompt is not null and story is not null")


@query(f"WITH {_PARSED}, t AS (SELECT block, row_number() OVER (ORDER BY block) - 1 AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT block FROM p)) SELECT block, prompt FROM p JOIN t USING (block) WHERE rn >= floor(n * 0.95::DOUBLE) AND prompt IS NOT NULL")
def held_out_prompts(spark, d):
    tail = ordering.held_out_tail(table(spark, d, "documents").select(F.col("doc_id").alias("block")), "block").select("block")
    return chat.parse_blocks(_story_lines(spark, d).join(tail, "block", "left_semi")).where("prompt is not null").select("block", "prompt")


@query("SELECT conv_id, turn, '<|user|>' || text || '<|endoftext|><|assistant|>' AS prompt FROM conversations WHERE role = 'user'")
def format_prompt(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", chat.open_prompt(F.col("text")).alias("prompt"))


@query(f"SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: ' ELSE '' END || {_STRIP.format('text')}, chr(10) ORDER BY turn) || chr(10) || 'Assistant:' AS prompt FROM conversations GROUP BY conv_id")
def format_chat(spark, d):
    return chat.plain_chat(table(spark, d, "conversations"))


_REQUEST = {
    "request_id": "event_id",
    "temperature": "CASE WHEN event_id % 3 > 0 THEN value / 500 END",
    "top_p": "CASE WHEN event_id % 4 > 0 THEN value / 1000 END",
    "top_k": "CAST(CASE WHEN event_id % 5 > 0 THEN event_id % 60 - 10 END AS INT)",
    "min_p": "CASE WHEN event_id % 7 > 0 THEN (event_id % 9 - 3) / 50 END",
    "presence_penalty": "CASE WHEN event_id % 2 > 0 THEN (event_id % 11 - 5) / 8 END",
    "frequency_penalty": "CASE WHEN event_id % 6 > 0 THEN value / 250 - 1 END",
}


@query("SELECT request_id, coalesce(temperature, 1::DOUBLE) AS temperature, top_p, CASE WHEN top_k > 0 THEN top_k END AS top_k, CASE WHEN min_p > 0 THEN min_p END AS min_p, 1 + greatest(coalesce(presence_penalty, 0), coalesce(frequency_penalty, 0), 0)::DOUBLE AS repetition_penalty FROM (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _REQUEST.items()) + " FROM events)")
def request_normalize(spark, d):
    """Each event as a request with some of the settings."""
    return chat.request_settings(table(spark, d, "events").selectExpr(*[f"{e} AS {c}" for c, e in _REQUEST.items()]))


@query("SELECT conv_id, turn, least(nullif(instr(text, ' de '), 0), nullif(instr(text, ' the '), 0), nullif(instr(text, '.'), 0)) - 1 AS stop_at FROM conversations")
def stop_hit(spark, d):
    stops = F.array(*[F.lit(s) for s in (" de ", " the ", "", ".")])
    return table(spark, d, "conversations").select("conv_id", "turn", stop_place(F.col("text"), stops).cast("long").alias("stop_at"))


@query(f"SELECT conv_id, turn, ids[greatest(1, len(ids) - 63):] AS ids FROM (SELECT conv_id, turn, CASE WHEN text = '' THEN [32] ELSE {_BYTES.format('text')} END AS ids FROM conversations)")
def prompt_truncate(spark, d):
    ids = F.expr("transform(filter(split(regexp_replace(hex(encode(text, 'UTF-8')), '(..)', '$1,'), ','), x -> x <> ''), x -> cast(conv(x, 16, 10) as int))")
    return table(spark, d, "conversations").select("conv_id", "turn", chat.last_ids(ids, 64, 32).alias("ids"))


@query(f"SELECT conv_id, turn, list_concat({_BYTES.format('text')}, [256, 256][1:greatest(turn % 3 - 1, 0)]) AS ids FROM conversations")
def strip_trailing_end(spark, d):
    """Turns with no, one and two end ids after them; one is taken off."""
    ids = F.concat(F.expr(ids_of("text")), F.expr("slice(array(256, 256), 1, cast(turn % 3 as int))"))
    return table(spark, d, "conversations").select("conv_id", "turn", chat.strip_end(ids, 256).alias("ids"))


@query(f"SELECT conv_id, turn, all_ids[greatest(1, len(all_ids) - 47):] AS ids FROM (SELECT conv_id, turn, flatten(list({_BYTES.format('text')}) OVER (PARTITION BY conv_id ORDER BY turn)) AS all_ids FROM conversations)")
def context_roll(spark, d):
    """What a chat's model sees at each turn: the last 48 ids so far, with room for 16 in a context of 64."""
    return chat.rolled_context(table(spark, d, "conversations").select("conv_id", "turn", F.expr(ids_of("text")).alias("ids")), 64 - 16)


@query(f"SELECT conv_id, turn, {_STRIP.format('text')} AS answer FROM conversations")
def strip_artifacts(spark, d):
    """Answers wrapped as a model returns them, and unwrapped."""
    t = table(spark, d, "conversations")
    prefix = chat.open_prompt(F.col("role"))
    return t.select("conv_id", "turn", chat.strip_artifacts(F.concat(prefix, F.lit("  "), "text", F.lit(END), F.lit("more")), prefix).alias("answer"))


_STOP = "(SELECT conv_id, turn, text, coalesce(nullif(instr(text, '.'), 0), 0) AS s FROM conversations WHERE role = 'assistant')"


@query(f"SELECT conv_id, turn, CASE WHEN s > 0 AND s <= 80 THEN substr(text, 1, s - 1) ELSE substr(text, 1, 80) END AS text, CASE WHEN s > 0 AND s <= 80 THEN 'stop' WHEN length(text) < 80 THEN 'stop' ELSE 'length' END AS finish_reason, least(80, length(text) + 1, CASE WHEN s > 0 THEN s ELSE 80 END)::BIGINT AS n_completion FROM {_STOP}")
def finish_reason(spark, d):
    """Answers read as one token for each character, then the end token: cut at the first stop string, ended by the end token, or by 80 tokens."""
    t = table(spark, d, "conversations").where("role = 'assistant'").withColumn("at", stop_place(F.col("text"), F.array(F.lit("."))) + 1)
    at = F.col("at")
    hit = at.isNotNull() & (at <= 80)
    text = F.when(hit, F.expr("substring(text, 1, instr(text, '.') - 1)")).otherwise(F.substring("text", 1, 80))
    why = F.when(hit | (F.length("text") < 80), "stop").otherwise("length")
    n = F.least(F.lit(80), F.length("text") + 1, F.coalesce(at, F.lit(80)))
    return t.select("conv_id", "turn", text.alias("text"), why.alias("finish_reason"), n.cast("long").alias("n_completion"))


@query("""SELECT conv_id, 0::BIGINT AS n, 'data: {"id":"c' || conv_id || '","delta":{"role":"assistant"}}' || chr(10) || chr(10) AS frame FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL SELECT conv_id, turn + 1, 'data: {"id":"c' || conv_id || '","delta":{"content":' || to_json(text) || '}}' || chr(10) || chr(10) FROM conversations WHERE text <> ''
UNION ALL SELECT conv_id, max(turn) + 2, 'data: {"id":"c' || conv_id || '","delta":{},"finish_reason":"stop"}' || chr(10) || chr(10) FROM conversations GROUP BY conv_id
UNION ALL SELECT conv_id, max(turn) + 3, 'data: [DONE]' || chr(10) || chr(10) FROM conversations GROUP BY conv_id""")
def sse_frames(spark, d):
    """A stream's frames: the role, the pieces, the reason of the end, and the end."""
    t = table(spark, d, "conversations")
    name = F.concat(F.lit("c"), F.col("conv_id"))
    last = t.groupBy("conv_id").agg(F.max("turn").alias("top"))

    def frame(*fields):
        return F.concat(F.lit("data: "), F.to_json(F.struct(name.alias("id"), *fields)), F.lit("\n\n")).alias("frame")

    role = last.select("conv_id", F.lit(0).cast("long").alias("n"), frame(F.struct(F.lit("assistant").alias("role")).alias("delta")))
    pieces = t.where("text <> ''").select("conv_id", (F.col("turn") + 1).alias("n"), frame(F.struct(F.col("text").alias("content")).alias("delta")))
    end = last.select("conv_id", (F.col("top") + 2).alias("n"), frame(F.expr("cast(map() as map<string,string>)").alias("delta"), F.lit("stop").alias("finish_reason")))
    done = last.select("conv_id", (F.col("top") + 3).alias("n"), F.lit("data: [DONE]\n\n").alias("frame"))
    return role.unionByName(pieces).unionByName(end).unionByName(done)
