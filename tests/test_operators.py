"""Invariants, round trips and small cases of the operators."""

import io
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as texts
from tessera.operators import bpe, chat, metrics, ordering, preference, sampling, tensor
from tessera.operators.transformer import Sampler, Transformer
from tessera.plans import streams
from tessera.sources import files
from tessera.streaming import decoder

CORPUS = "low low low low low\nlower lower widest widest\nnewest newest newest newest newest newest"


@pytest.fixture(scope="module")
def tokenizer(spark):
    docs = spark.createDataFrame([(0, CORPUS), (1, "hello world\n")], "doc_id long, text string")
    merges = bpe.train(bpe.word_sequences(bpe.word_freqs(docs)), 20)
    return merges, bpe.vocabulary(spark, merges)


def _roundtrip(spark, tokenizer, strings):
    merges, vocab = tokenizer
    docs = spark.createDataFrame(list(enumerate(strings)), "doc_id long, text string")
    e = bpe.encoded_arrays(docs, merges, vocab)
    back = {r.doc_id: r.text for r in bpe.decode(e, vocab).collect()}
    return {r.doc_id: r.ids for r in e.collect()}, back


def test_encode_decode(spark, tokenizer):
    strings = ["hello", "low lower", "newest widest", "Hello, world!", "café résumé naïve", "hello<|endoftext|>world", ""]
    ids, back = _roundtrip(spark, tokenizer, strings)
    assert [back.get(k, "") for k in range(len(strings))] == strings
    assert 256 in ids[5] and ids[6] == []


def test_training_matches_plain_python(spark, tokenizer):
    import regex

    words = {}
    for t in (CORPUS, "hello world\n"):
        for w in regex.findall(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", t):
            words[w] = words.get(w, 0) + 1
    seqs = {w: [f"{b:02X}" for b in w.encode()] for w in words}
    for a, b, c in tokenizer[0]:
        n = {}
        for w, s in seqs.items():
            for p in zip(s, s[1:]):
                n[p] = n.get(p, 0) + words[w]
        top = max(n.items(), key=lambda x: (x[1], x[0]))
        assert ((a, b), c) == top
        for w, s in seqs.items():
            out, i = [], 0
            while i < len(s):
                out.append(a + b if s[i : i + 2] == [a, b] else s[i])
                i += 2 if s[i : i + 2] == [a, b] else 1
            seqs[w] = out


def test_greedy_fallback_for_repeated_outputs(spark):
    merges = [("61", "62"), ("6162", "63"), ("62", "63"), ("61", "6263")]  # abc from two sides
    words = spark.createDataFrame([("abc",), ("bc",), ("aabc",)], "word string")
    got = {r.word: r.tokens for r in bpe.segmented(words, merges).collect()}
    assert got == {"abc": ["616263"], "bc": ["6263"], "aabc": ["61", "616263"]}


def test_invalid_bytes_decode(spark, tokenizer):
    t = spark.createDataFrame([(0, [0xC3, 0x28, 0xFF])], "doc_id long, ids array<int>")
    assert bpe.decode(t, tokenizer[1]).first().text == bytes([0xC3, 0x28, 0xFF]).decode("utf-8", "replace")


def test_vocabulary_files(spark, tokenizer):
    merges, vocab = tokenizer
    assert sorted(map(tuple, files.vocab_from_json(files.vocab_json(vocab)).collect())) == sorted(map(tuple, vocab.collect()))
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(merges)], "rank int, a string, b string")
    assert sorted(map(tuple, files.merges_from_text(files.merges_text(rows)).collect())) == sorted(map(tuple, rows.collect()))


def test_sources_and_sinks(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(5, dtype=np.uint16))
    assert files.read_npy(spark, str(tmp_path / "a.npy")).first().ids == [0, 1, 2, 3, 4]
    (tmp_path / "d.txt").write_text("one<|endoftext|>two\nlines<|endoftext|>")
    assert [r.text for r in files.read_text_documents(spark, str(tmp_path / "d.txt"), "<|endoftext|>").collect()] == ["one", "two\nlines"]
    df = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "j"), "k int, v string").collect()), key=repr) == [(1, "x"), (2, None)]
    files.append_csv_log(df, str(tmp_path / "log"))
    files.append_csv_log(df, str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 4
    files.write_checkpoint(df, str(tmp_path / "ck"), 7)
    assert spark.read.parquet(str(tmp_path / "ck/step_000007")).count() == 2


def test_unknown_role_is_an_error(spark):
    t = spark.createDataFrame([(0, 0, "tool", "x")], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="Unknown role"):
        t.select(chat.turn_text()).collect()


def test_response_mask_and_shift(spark):
    t = spark.createDataFrame([(0, 0, "user", "hi"), (0, 1, "assistant", "yo"), (1, 0, "system", "x")], "conv_id long, turn long, role string, text string")
    e = chat.format_examples(t, [], bpe.vocabulary(spark, []), 64)
    r = {x.conv_id: x for x in e.collect()}
    assert r[0].ids == [257, 104, 105, 256, 258, 121, 111, 256] and r[0].mask == [0, 0, 0, 0, 0, 1, 1, 1]
    assert sum(r[1].mask) == 0
    p = {x.conv_id: x for x in chat.pad_and_shift(e, 10, 256).collect()}[0]
    assert p.input_ids[:7] == r[0].ids[:-1] and p.target_ids[:7] == r[0].ids[1:] and len(p.input_ids) == 9
    assert p.loss_mask == [0, 0, 0, 0, 1, 1, 1, 0, 0] and p.attention_mask == [True] * 7 + [False] * 2
    short = spark.createDataFrame([(0, [5], [1])], "conv_id long, ids array<int>, mask array<int>")
    assert chat.pad_and_shift(short, 4, 9).first().input_ids == [9, 9, 9]
    with pytest.raises(ValueError):
        chat.pad_and_shift(short, 1, 9)


def test_plain_chat_and_stops(spark):
    t = spark.createDataFrame([(0, 0, "system", " Be kind. "), (0, 1, "user", "Hi"), (0, 2, "assistant", "Yo"), (0, 3, "user", "Bye")], "conv_id long, turn long, role string, text string")
    assert chat.plain_chat(t).first().prompt == "Be kind.\nUser: Hi\nAssistant: Yo\nUser: Bye\nAssistant:"
    stop = spark.createDataFrame([("once upon a time and then end here", ["end", "and"]), ("none", ["x"]), ("a", [""])], "t string, s array<string>")
    assert [r[0] for r in stop.select(texts.stop_place(F.col("t"), F.col("s"))).collect()] == [17, None, None]


def test_pair_filter_and_verdicts(spark):
    a, b = "a" * 60, "b" * 60
    rows = [(a, b, True), (a, a, False), ("short", b, False), (a, "a" * 25 + "c" * 80, False), ("x" + "y" * 60, "z" + "q" * 9 + "y" * 51, False), (a, "z" * 100, True)]
    df = spark.createDataFrame(rows, "a string, b string, k boolean")
    assert [r[0] for r in df.select(preference.keep_pair(F.col("a"), F.col("b"))).collect()] == [k for *_, k in rows]
    v = spark.createDataFrame([("because A",), ("a",), ("neither",), (None,)], "t string")
    assert [r[0] for r in v.select(preference.verdict(F.col("t"))).collect()] == ["B", "A", None, None]


def test_losses(spark):
    x = spark.createDataFrame([(0, 0, 1000.0), (0, 1, 1001.0), (0, 2, 1002.0)], "s int, tok int, logit double")
    lp = {r.tok: r.logp for r in metrics.log_softmax(x, ["s"]).collect()}
    assert math.isclose(-lp[2], math.log(sum(math.exp(v) for v in (-2, -1, 0))), rel_tol=1e-9)
    same = spark.createDataFrame([(-5.0, -6.0, -5.0, -6.0)], "policy_chosen double, policy_rejected double, ref_chosen double, ref_rejected double")
    assert math.isclose(metrics.dpo(same, 0.1).first().loss, math.log(2))
    none = spark.createDataFrame([(1.0, 0.0)], "nll double, mask double")
    assert none.agg(metrics.masked_mean(F.col("nll"), F.col("mask"))).first()[0] == 0


def test_samplers(spark):
    logits = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate([3, 2, 2, 1, 0])], "ctx int, tok int, logit double")
    assert sorted(r.tok for r in sampling.top_k(logits, 2).collect()) == [0, 1, 2]  # ties stay
    p = sampling.sampler(logits, 0.8, 10, 0.05, 0.9)
    assert math.isclose(sum(r.p for r in p.collect()), 1.0)
    assert sampling.top_p(p, 1e-9).count() == 1 and sampling.draw(p, "s").count() == 1


def test_rope_keeps_norms_and_attention_is_causal(spark):
    rng = random.Random(0)
    rows = [(0, 0, k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(12)]
    df = spark.createDataFrame(rows, "seq int, head int, pos int, q array<double>")
    r = df.select("q", tensor.rope(F.col("q"), F.col("pos"), 8).alias("y")).collect()
    assert all(math.isclose(sum(v * v for v in x.q), sum(v * v for v in x.y), rel_tol=1e-9) for x in r)
    full = df.select("*", F.col("q").alias("k"), F.col("q").alias("v"), F.lit(True).alias("real"))
    one = {x.pos: x.out for x in tensor.attention(full).collect()}
    chunk = {x.pos: x.out for x in tensor.attention(full, chunk=5).collect()}
    cut = {x.pos: x.out for x in tensor.attention(full.where("pos < 6")).collect()}
    assert all(np.allclose(one[k], chunk[k]) for k in one) and all(np.allclose(one[k], cut[k]) for k in cut)


def test_cache_matches_full_forward():
    m = Transformer(seed=1)
    ids = np.arange(20) * 7 % 256
    cache = []
    steps = np.concatenate([m.logits(ids[:5], cache)] + [m.logits(ids[k : k + 1], cache) for k in range(5, 20)])
    assert np.allclose(m.logits(ids), steps, atol=1e-9)
    assert len(m.generate([1, 2, 3], 10, 8)) == 10


def test_ranks_and_batches(spark):
    df = spark.createDataFrame([(k * 37 % 101,) for k in range(101)], "doc_id long")
    assert all(r.rn == r.doc_id for r in ordering.ranked(df, "doc_id").collect())
    assert ordering.held_out_tail(df, "doc_id").count() == 101 - int(101 * 0.95)
    assert ordering.epoch_batches(df, "doc_id", 200, ["a"]).count() == 0
    assert ordering.ranked(df.limit(0), "doc_id").count() == 0


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=40))
def test_incremental_decoding(raw):
    text, held = "", b""
    for b in raw:
        piece, held = decoder.valid_prefix(held + bytes([b]))
        text += piece
    assert (text + held.decode("utf-8", "replace")).encode("utf-8", "replace") is not None
    if raw.decode("utf-8", "ignore").encode() == raw:
        assert text == raw.decode()


def test_streaming_decoder(spark, tmp_path):
    rows = [(1, 0, b"\xc3", False), (1, 1, b"\xa9", True), (2, 0, b"a", False), (2, 1, b"\xc3", True)]
    df = spark.createDataFrame(rows, "stream long, pos long, tok binary, last boolean")
    want = {(1, 0): "", (1, 1): "é", (2, 0): "a", (2, 1): "�"}
    assert {(r.stream, r.pos): r.piece for r in decoder.decode_batch(df).collect()} == want
    df.write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = decoder.run_available(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), decoder.decode_stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert {(r.stream, r.pos): r.piece for r in got.collect()} == want


def test_npy_rows(spark):
    f = io.BytesIO()
    np.save(f, np.array([3, 1], np.uint16))
    df = spark.createDataFrame([(1, bytearray(f.getvalue()))], "doc_id long, content binary")
    assert files.parse_npy(df).first().ids == [3, 1]


def test_many_merges_match_plain_python(spark):
    """Training in rounds of independent merges, and encoding, against one merge at a time."""
    from collections import Counter

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    words = {r.word: r.cnt for r in bpe.word_freqs(docs).collect()}
    got = bpe.train(bpe.word_sequences(spark.createDataFrame(list(words.items()), "word string, cnt long")), 80)
    tokens = {w: [f"{x:02X}" for x in w.encode()] for w in words}
    want = []
    for _ in range(80):
        pairs = Counter()
        for w, t in tokens.items():
            for p in zip(t, t[1:]):
                pairs[p] += words[w]
        if not pairs:
            break
        (a, b), c = max(pairs.items(), key=lambda x: (x[1], x[0]))
        want.append((a, b, c))
        for w, t in tokens.items():
            out, k = [], 0
            while k < len(t):
                two = t[k : k + 2] == [a, b]
                out.append(a + b if two else t[k])
                k += 1 + two
            tokens[w] = out
    assert got == want
    some = spark.createDataFrame([(w,) for w in list(words)[:500]], "word string")
    assert {r.word: r.tokens for r in bpe.segmented(some, got).collect()} == {w: tokens[w] for w in list(words)[:500]}


def _plain_logits(m, ids):
    """The last place's logits by loops over places, heads and layers, without a cache."""
    unit = lambda v: v / math.sqrt(sum(x * x for x in v) / len(v) + 1e-5)
    xs = [m.embed[i] for i in ids]

    def turned(v, at):
        out = []
        for j in range(m.dk // 2):
            a = at / 10000 ** (2 * j / m.dk)
            out += [v[2 * j] * math.cos(a) - v[2 * j + 1] * math.sin(a), v[2 * j] * math.sin(a) + v[2 * j + 1] * math.cos(a)]
        return np.array(out)

    for b in m.blocks:
        hs = [unit(x) for x in xs]
        new = []
        for i, h in enumerate(hs):
            heads = []
            for n in range(m.heads):
                g = n // (m.heads // m.kv_heads)
                q = turned((b["q"] @ h)[n * m.dk : (n + 1) * m.dk], i)
                keys = [turned((b["k"] @ hs[j])[g * m.dk : (g + 1) * m.dk], j) for j in range(i + 1)]
                e = [math.exp(q @ k / math.sqrt(m.dk)) for k in keys]
                heads.append(sum(w / sum(e) * (b["v"] @ hs[j])[g * m.dk : (g + 1) * m.dk] for j, w in enumerate(e)))
            x = xs[i] + b["o"] @ np.concatenate(heads)
            gate = b["w1"] @ unit(x)
            new.append(x + b["w2"] @ (gate / (1 + np.exp(-gate)) * (b["w3"] @ unit(x))))
        xs = new
    return np.array([m.embed @ unit(x) for x in xs])


def _plain_stream(m, ids, new, context, end, choose):
    ids, out = list(ids) or [32], []
    for step in range(new):
        ids = ids[-context:]
        out.append(choose(_plain_logits(m, ids)[-1], ids, step))
        if out[-1] == end:
            break
        ids.append(out[-1])
    return out


def test_generation_queries_match_plain_loops(spark, tmp_path):
    said = ["hi there", "", "once upon a time, a cat. " * 3, "ü"]
    rows = [(k, 0, "user", s) for k, s in enumerate(said)] + [(9, 0, "assistant", "no prompt")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    m = Transformer()
    greedy = {r.seq: r.ids for r in streams.generate(spark, str(tmp_path)).collect()}
    assert greedy == {k * 100: _plain_stream(m, s.encode(), 16, 64, None, lambda z, seen, step: int(np.argmax(z))) for k, s in enumerate(said)}
    sampled = {}
    for r in streams.generate_stream(spark, str(tmp_path)).orderBy("seq", "step").collect():
        sampled.setdefault(r.seq, []).append(r.id)
    assert sampled == {k * 100: _plain_stream(m, s.encode(), 16, 64, 10, streams.SAMPLER.of(k * 100)) for k, s in enumerate(said)}
    got = {r.seq: r.nll for r in streams.transformer_forward(spark, str(tmp_path)).collect()}
    for k, s in enumerate([*said, *[""] * 5, "no prompt"]):
        ids = s.encode()
        for w in range(0, len(ids), 64):
            part = list(ids[w : w + 64])
            z = _plain_logits(m, part)[:-1]
            due = np.mean([math.log(sum(map(math.exp, v))) - v[t] for v, t in zip(z, part[1:], strict=True)]) if len(part) > 1 else None
            assert got.pop(k * 1_000_000 + w // 64) == (None if due is None else pytest.approx(due, abs=1e-5))
    assert not got


def test_sampler_of_a_vector_is_the_chain_of_tables(spark):
    z = [1.5, -0.5, 2.0, 2.0, 0.1, -3.0, 1.2]
    logits = spark.createDataFrame([(0, k, v) for k, v in enumerate(z)], "ctx int, tok int, logit double")
    seen = spark.createDataFrame([(0, 2), (0, 5), (0, 2)], "ctx int, tok int")
    rows = sampling.sampler(sampling.repetition_penalty(logits, seen, 1.3), 0.7, 5, 0.05, 0.8).collect()
    due = np.zeros(len(z))
    for r in rows:
        due[r.tok] = r.p
    assert np.allclose(Sampler(0.7, 5, 0.05, 0.8, 1.3).distribution(np.array(z), [2, 5, 2]), due)


def test_long_texts_split_at_specials(spark):
    text = "x\n" * 200_000
    df = spark.createDataFrame([(text + "<|user|>" + text,), ("",), (None,)], "text string")
    got = [r[0] for r in df.select(texts.split_specials("text", keep=True)).collect()]
    assert got == [[text, "<|user|>", text], [], None]


def test_chunks_ends_and_numbers(spark):
    df = spark.createDataFrame([(0, "aé𝄞\nb"), (1, ""), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in files.text_chunks(df, 2).orderBy("chunk").collect()] == [(0, 0, "aé"), (0, 1, "𝄞\n"), (0, 2, "b")]
    ids = spark.createDataFrame([([],), ([7],), ([7, 7],), ([1],), (None,)], "ids array<int>")
    assert [r[0] for r in ids.select(chat.strip_end(F.col("ids"), 7)).collect()] == [[], [], [7], [1], None]
    assert files.parse_npy(files.npy_payloads(ids)).where("size(ids) = 2").count() == 1
    for bad in (65_536, -1):
        with pytest.raises(Exception, match="16 bits"):
            files.npy_payloads(spark.createDataFrame([([bad],)], "ids array<int>")).collect()


def test_rolled_context_of_many_turns(spark):
    rnd = random.Random(3)
    turns = [(c, t, [rnd.randrange(9) for _ in range(rnd.choice((0, 0, 1, 3, 12)))]) for c in range(3) for t in range(40)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, ids array<int>")
    for r in chat.rolled_context(df, 8).collect():
        assert r.ids == [x for c, t, ids in turns if c == r.conv_id and t <= r.turn for x in ids][-8:]
