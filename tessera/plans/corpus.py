"""Scans, splits, windows and orders of the corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as texts
from tessera.functions.text import END, byte_ids, universal_newlines, utf16_ids
from tessera.operators import bpe, ordering, token_stream
from tessera.plans.base import query, spread, sql_pretokens, sql_words, table
from tessera.sources import files
from tessera.sources.scratch import shared_dir, small_batches


@query("SELECT doc_id, md5(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS text_md5, length(regexp_replace(text, '\\r\\n?', chr(10), 'g'))::BIGINT AS n_chars FROM documents")
def scan_documents(spark, d):
    text = universal_newlines("text")
    return table(spark, d, "documents").select("doc_id", F.md5(text.cast("binary")).alias("text_md5"), F.length(text).cast("long").alias("n_chars"))


@query("SELECT doc_id, strlen(text)::BIGINT AS n_ids, ord(text[1])::BIGINT AS first_char FROM documents")
def scan_npy(spark, d):
    """Ids of UTF-16 units written as .npy payloads and read back."""
    saved = files.npy_payloads(table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_ids"), utf16_ids("text").alias("ids")))
    ids = files.parse_npy(saved, "content")
    return ids.select("doc_id", "n_ids", F.when(F.col("n_ids").isNotNull(), texts.first_code_point("ids")).alias("first_char"))


@query("SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) u(i)")
def scan_lines(spark, d):
    return files.lines(table(spark, d, "documents")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query("SELECT doc_id, rn FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents) WHERE rn >= floor(n * 0.95::DOUBLE)")
def held_out_tail(spark, d):
    return ordering.held_out_tail(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("SELECT text AS prompt, conv_id, turn FROM conversations WHERE trim(text) <> ''")
def scan_jsonl(spark, d):
    """Conversations written as JSON lines, with blank lines between, and read by schema."""
    rows = table(spark, d, "conversations").select(F.explode(F.array(F.to_json(F.struct(F.col("text").alias("prompt"), "conv_id", "turn")), F.lit("  "))).alias("line"))
    return files.json_rows(rows, "line", "prompt string, conv_id long, turn long").where(F.trim("prompt") != "")


@query("""WITH t AS (SELECT doc_id, text || '<|endoftext|>' || lang || '<|endoftext|>' || source AS t FROM documents)
SELECT doc_id, (i - 1)::BIGINT AS n, length(array_to_string(string_split(t, '<|endoftext|>')[1:i], '<|endoftext|>'))::BIGINT AS at FROM t, unnest(range(1, len(string_split(t, '<|endoftext|>')))) u(i)""")
def chunk_boundaries(spark, d):
    """Character offsets of the end-of-text marks."""
    t = table(spark, d, "documents").select("doc_id", texts.split_specials(F.concat_ws(END, "text", "lang", "source"), (END,)).alias("p"))
    sums = F.transform(F.col("p"), lambda x, i: F.aggregate(F.slice(F.col("p"), 1, i + 1), F.lit(0), lambda s, y: s + F.length(y)) + i * len(END))
    t = t.select("doc_id", F.posexplode(F.slice(sums, F.lit(1), F.size("p") - 1)).alias("n", "at"))
    return t.select("doc_id", F.col("n").cast("long").alias("n"), F.col("at").cast("long").alias("at"))


@query("SELECT doc_id, (i - 1)::BIGINT AS n, p[i] AS piece FROM (SELECT doc_id, string_split(text || '<|endoftext|>' || lang, '<|endoftext|>') AS p FROM documents), unnest(range(1, len(p) + 1)) u(i)")
def split_specials(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(texts.split_specials(F.concat_ws(END, "text", "lang"), (END,))).alias("n", "piece")).select("doc_id", F.col("n").cast("long").alias("n"), "piece")


def _pieces(spark, d, marks, specials):
    """Pieces and specials of text, lang and source with `marks` between them; empty pieces are none."""
    parts = [F.coalesce(c, F.lit("")) for c in ("text", "lang", "source")]
    whole = F.concat(parts[0], *[x for m, p in zip(marks, parts[1:], strict=True) for x in (F.lit(m), p)])
    return table(spark, d, "documents").select("doc_id", F.posexplode(texts.split_specials(whole, specials, keep=True)).alias("n", "piece")).select("doc_id", F.col("n").cast("long").alias("n"), "piece")


def _sql_pieces(first, second):
    pieces = f"[coalesce(text, ''), {first}, coalesce(lang, ''), {second}, coalesce(source, '')]"
    return f"SELECT doc_id, (i - 1)::BIGINT AS n, p[i] AS piece FROM (SELECT doc_id, list_filter({pieces}, lambda x: x <> '') AS p FROM documents), unnest(range(1, len(p) + 1)) u(i)"


@query(_sql_pieces("'<|endoftext|>'", "'<|user|>', '<|endoftext|>'"))
def encode_specials(spark, d):
    return _pieces(spark, d, (END, "<|user|>" + END), texts.SPECIALS)


@query(_sql_pieces("'<|end|>'", "'<|end|><|end|>', '<|end|>'"))
def overlapping_specials(spark, d):
    """A special that starts another one: the longer is taken first."""
    return _pieces(spark, d, ("<|end|>", "<|end|>" * 3), ("<|end|>", "<|end|><|end|>"))


@query("SELECT doc_id, (i - 1)::BIGINT AS chunk, c[i] AS text FROM (SELECT doc_id, regexp_extract_all(text, '(?s).{1,500}') AS c FROM documents), unnest(range(1, len(c) + 1)) u(i)")
def chunked_text(spark, d):
    return files.text_chunks(table(spark, d, "documents"), 500).withColumn("chunk", F.col("chunk").cast("long"))


@query("SELECT doc_id AS seq, list_transform(range(0, (1 + n_chars % 40)::BIGINT), lambda i: floor(('0x' || substr(md5('tokens|' || doc_id || '|' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 1000)::INT) AS ids FROM documents")
def synthetic_tokens(spark, d):
    """Seeded ids in place of each document's own, of a length that follows from the document's."""
    return files.synthetic_tokens(table(spark, d, "documents").select(F.col("doc_id").alias("seq"), (1 + F.col("n_chars") % 40).cast("int").alias("length")), 1000, "tokens")


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS seconds, floor(epoch(ts))::BIGINT - min(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id) AS elapsed FROM events")
def event_clock(spark, d):
    """Whole seconds since 1970 of each event, and since its user's first."""
    t = table(spark, d, "events").select("event_id", "user_id", texts.epoch_seconds("ts").alias("seconds"))
    first = t.groupBy(F.col("user_id").alias("who")).agg(F.min("seconds").alias("first"))
    return t.join(first, F.col("user_id").eqNullSafe(F.col("who"))).select("event_id", "seconds", (F.col("seconds") - F.col("first")).alias("elapsed"))


@query(f"SELECT doc_id, (i - 1)::BIGINT AS pos, w[i] AS word FROM (SELECT doc_id, {sql_pretokens('text')} AS w FROM documents), unnest(range(1, len(w) + 1)) u(i)")
def pretokenize(spark, d):
    return bpe.pretokenize(spread(table(spark, d, "documents"))).select("doc_id", F.col("pos").cast("long").alias("pos"), "word")


@query(f"WITH {sql_words()} SELECT word, cnt FROM words")
def word_freqs(spark, d):
    return bpe.word_freqs(spread(table(spark, d, "documents")))


@query(f"WITH {sql_words()} SELECT word, seq, cnt FROM words")
def word_bytes(spark, d):
    return bpe.word_sequences(bpe.word_freqs(spread(table(spark, d, "documents"))))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < floor(count(*) OVER () * (1 - 0.1::DOUBLE)) THEN 'train' ELSE 'val' END AS split FROM documents")
def train_val_split(spark, d):
    return ordering.train_val_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.1).select("doc_id", "split")


_MIX = "('0x' || substr(md5(doc_id::VARCHAR || '|' || '{}'), 1, 15))::BIGINT"


@query(f"SELECT doc_id, place, CASE WHEN place < floor(n * 0.05::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY {_MIX.format('seed-0')}, doc_id) - 1 AS place, count(*) OVER () AS n FROM documents)")
def shuffle_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    n = docs.count()
    return ordering.shuffled(docs, "doc_id", "seed-0").withColumn("split", F.when(F.col("place") < int(n * 0.05), "val").otherwise("train"))


@query(" UNION ALL ".join(f"SELECT '{s}' AS seed, place // 32 AS batch, place % 32 AS slot, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_MIX.format(s)}, doc_id) - 1 AS place, count(*) OVER () AS n FROM documents) WHERE place < n // 32 * 32" for s in ("epoch-0", "epoch-1")))
def epoch_batches(spark, d):
    return ordering.epoch_batches(table(spark, d, "documents").select("doc_id"), "doc_id", 32, ["epoch-0", "epoch-1"])


@query(f"SELECT doc_id FROM documents ORDER BY {_MIX.format('prompts')}, doc_id LIMIT 100")
def seeded_head(spark, d):
    """The first hundred documents of a seeded shuffle."""
    return ordering.seeded_head(table(spark, d, "documents").select("doc_id"), "doc_id", "prompts", 100)


def _byte_ids(docs):
    """doc_id and the ids of the text's bytes."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", byte_ids("text").alias("ids"))


_IDS = "SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::INT) AS ids FROM documents"


@query(f"SELECT doc_id, (w - 1)::BIGINT AS window_no, len(ids[(w - 1) * 128 + 1 : w * 128])::BIGINT AS n_ids, list_sum(ids[(w - 1) * 128 + 1 : w * 128])::BIGINT AS id_sum FROM ({_IDS}), unnest(range(1, (len(ids) + 127) // 128 + 1)) u(w)")
def context_windows(spark, d):
    """Windows of 128 byte ids that don't overlap."""
    t = _byte_ids(table(spark, d, "documents")).where("size(ids) > 0")
    t = t.select("doc_id", F.posexplode(F.expr("transform(sequence(1, size(ids), 128), s -> slice(ids, s, 128))")).alias("window_no", "w"))
    return t.select("doc_id", F.col("window_no").cast("long").alias("window_no"), F.size("w").cast("long").alias("n_ids"), F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + x).alias("id_sum"))


@query(f"SELECT doc_id, k::BIGINT AS draw, s::BIGINT AS start, list_sum(ids[s + 1 : s + 64])::BIGINT AS input_sum, list_sum(ids[s + 2 : s + 65])::BIGINT AS target_sum FROM (SELECT doc_id, ids, k, floor((('0x' || substr(md5(doc_id::VARCHAR || '-' || k::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * (len(ids) - 64)) AS s FROM ({_IDS}), unnest([0, 1, 2]) u(k) WHERE len(ids) > 64)")
def get_batch(spark, d):
    """Three windows of 64 ids of each document at starts drawn by hash, with their targets one id on."""
    from tessera.functions.text import uniform

    t = _byte_ids(table(spark, d, "documents")).where("size(ids) > 64").select("doc_id", "ids", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k"))
    t = t.withColumn("s", F.floor(uniform(F.concat_ws("-", "doc_id", "k")) * (F.size("ids") - 64)).cast("int"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return t.select("doc_id", F.col("k").cast("long").alias("draw"), F.col("s").cast("long").alias("start"), total(F.expr("slice(ids, s + 1, 64)")).alias("input_sum"), total(F.expr("slice(ids, s + 2, 64)")).alias("target_sum"))


@query("""SELECT doc_id, i - 1 AS line_no, l[i] AS line, sum(CASE WHEN l[i] = '' OR (i - 1) % 4 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS block
FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) u(i) QUALIFY NOT (l[i] = '' OR (i - 1) % 4 = 3)""")
def line_blocks(spark, d):
    """Blocks of lines between separators (empty lines and every fourth line stand for them)."""
    return files.line_blocks(files.lines(table(spark, d, "documents")), (F.col("line") == "") | (F.col("line_no") % 4 == 3)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line", "block")


@query("""SELECT doc_id, turn, id, lead(id) OVER (PARTITION BY doc_id ORDER BY turn) AS target FROM (SELECT conv_id AS doc_id, turn, length(text)::BIGINT AS id FROM conversations)""")
def next_token_shift(spark, d):
    """Each turn's length as an id, with the next turn's as its target."""
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.length("text").cast("long").alias("id"))
    return t.withColumn("target", F.lead("id").over(Window.partitionBy("doc_id").orderBy("turn")))


_STREAM = f"stream AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, id FROM (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM ({_IDS})))"


def _stream(spark, d):
    """The byte ids of all documents, one after the other."""
    return token_stream.stream(_byte_ids(table(spark, d, "documents")), "doc_id")


def _sums(found, *names):
    """Sums of a window's ids, plain and by place, which tell their order as well."""
    return token_stream.sums(found, list(names))


_PLACED = "count(*) FILTER (k < n)::BIGINT AS n_ids, sum(id) FILTER (k < n)::BIGINT AS input_sum, sum((k + 1) * id) FILTER (k < n)::BIGINT AS input_placed, sum(id) FILTER (k > 0)::BIGINT AS target_sum, sum(k * id) FILTER (k > 0)::BIGINT AS target_placed"


@query(f"""WITH {_STREAM}, draws AS (SELECT draw, floor((('0x' || substr(md5('batch-' || draw), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * ((SELECT count(*) FROM stream) - 256))::BIGINT AS start FROM range(512) r(draw)),
places AS (SELECT draw, start, k, 256 AS n, start + k AS pos FROM draws, unnest(range(257)) u(k))
SELECT draw, start, {_PLACED} FROM places JOIN stream USING (pos) GROUP BY draw, start""")
def stream_batch(spark, d):
    """A batch of 512 windows of 256 ids, at starts drawn from the whole stream, with their targets; windows go across documents."""
    return _sums(token_stream.get_batch(_stream(spark, d), 512, 256, "batch"), "draw", "start")


@query(f"""WITH {_STREAM}, last AS (SELECT max(pos) AS last FROM stream), places AS (SELECT pos // 256 AS window_no, pos % 256 AS k, least(256, last - pos // 256 * 256) AS n, id FROM stream, last
  UNION ALL SELECT pos // 256 - 1, 256, 256, id FROM stream WHERE pos % 256 = 0 AND pos > 0)
SELECT window_no, window_no * 256 AS start, {_PLACED} FROM places GROUP BY window_no HAVING count(*) > 1""")
def stream_windows(spark, d):
    """The whole stream in windows of 256 ids with their targets."""
    return _sums(token_stream.context_windows(_stream(spark, d), 256), "window_no", "start")


@query("""WITH l AS (SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) u(i))
SELECT doc_id, line_no, md5(line) AS line_md5, block FROM (SELECT *, line = '' OR length(line) % 7 = 3 AS sep, sum((line = '' OR length(line) % 7 = 3)::BIGINT) OVER (ORDER BY doc_id, line_no)::BIGINT AS block FROM l) WHERE NOT sep""")
def corpus_blocks(spark, d):
    """Blocks of lines between separators (empty lines and some lengths stand for them) over the whole table: a block goes on from one document to the next."""
    rows = files.corpus_blocks(files.lines(table(spark, d, "documents")), (F.col("line") == "") | (F.length("line") % 7 == 3))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5(F.col("line").cast("binary")).alias("line_md5"), "block")


def _one_corpus(spark, d):
    """Documents as text files with the end mark behind each, in order."""
    at = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    docs.select(F.coalesce("text", F.lit("")).alias("value")).write.option("lineSep", END).text(at)
    return files.read_split_documents(spark, at, END)


@query("SELECT md5(coalesce(text, '')) AS text_md5, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, (sum(octet_length(encode(coalesce(text, ''))) + 13) OVER (ORDER BY doc_id) - octet_length(encode(coalesce(text, ''))) - 13)::BIGINT AS at FROM documents")
def scan_split_files(spark, d):
    """Documents of files that many tasks share by byte ranges, each with its first byte in the whole corpus."""
    docs = _one_corpus(spark, d)
    found = ordering.running_totals(docs, ["file", "block", "nth"], {"at": F.octet_length("text") + len(END)})
    return found.select(F.md5(F.col("text").cast("binary")).alias("text_md5"), F.octet_length("text").cast("long").alias("n_bytes"), "at")


@query("""WITH e AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, (sum(octet_length(encode(coalesce(text, ''))) + 13) OVER (ORDER BY doc_id))::BIGINT AS e FROM documents),
cuts AS (SELECT 0 AS k, 0 AS p UNION ALL SELECT k, e - 13 FROM e UNION ALL SELECT max(k) + 1, max(e) FROM e), n AS (SELECT count(*) AS n, greatest(1, (count(*) - 1) // 8) AS step FROM cuts)
SELECT CASE WHEN k = n - 1 THEN 8 ELSE k // step END::BIGINT AS chunk, p::BIGINT AS at FROM cuts, n WHERE k = n - 1 OR (k % step = 0 AND k < 8 * step)""")
def corpus_chunks(spark, d):
    """Eight chunks of a corpus, cut at end marks."""
    return files.chunk_starts(_one_corpus(spark, d), END, 8)
