"""BPE training, its inverted table, and encoding, against plain Python."""

import random
from collections import Counter

import pytest

from tessera.functions.text import SPECIALS
from tessera.operators import bpe, merging


def _plain(words, most):
    """One merge at a time; pairs stand in sets by their counts, and only words with the merged pair are counted anew."""
    own, counts, where, out, by = [list(t) for t, _ in words], Counter(), {}, [], {}

    def add(p, n):
        by.get(counts[p], set()).discard(p)
        counts[p] += n
        by.setdefault(counts[p], set()).add(p)

    for k, (t, n) in enumerate(words):
        for p in zip(t, t[1:]):
            add(p, n)
            where.setdefault(p, set()).add(k)
    while len(out) < most:
        c = max((n for n, s in by.items() if s and n > 0), default=0)
        if not c:
            break
        a, b = max(by[c])
        out.append((a, b, c))
        for k in where.pop((a, b)):
            now = merging.replaced(own[k], a, b)
            for p in zip(own[k], own[k][1:]):
                add(p, -words[k][1])
            for p in zip(now, now[1:]):
                add(p, words[k][1])
                where.setdefault(p, set()).add(k)
            own[k] = now
        by = {n: s for n, s in by.items() if s}
    return out, own


def _hex(words):
    return [([f"{x:02X}" for x in w.encode()], n) for w, n in words]


def test_plain_version_recounts():
    words = _hex([("aaa", 2), ("cc", 1)])
    assert _plain(words, 3)[0] == [("61", "61", 4), ("6161", "61", 2), ("63", "63", 1)]


def _run_heavy(rng):
    letters = rng.choice(["ab", "abc", "a", " -=", "éab"])
    words = Counter()
    for _ in range(rng.randint(1, 40)):
        words["".join(rng.choice(letters) if rng.random() < 0.5 else letters[0] for _ in range(rng.randint(1, 14)))] += rng.choice([1, 1, 2, 5])
    return list(words.items())


@pytest.mark.parametrize("top, sequences", [(1 << 16, 100_000), (1, 100_000), (5, 100_000), (64, 3)])
def test_training_on_runs_of_one_character(spark, monkeypatch, top, sequences):
    """Words with runs, ties and tokens of the same bytes by two routes, in rounds of every width."""
    monkeypatch.setattr(bpe, "TOP_PAIRS", top)
    monkeypatch.setattr(bpe, "SEQUENCES", sequences)
    for seed in range(2):
        words = [("aaa", 2), ("cc", 1)] if seed == 0 else _run_heavy(random.Random(seed + top))
        got = bpe.train(bpe.word_sequences(spark.createDataFrame(words, "word string, cnt long")), 12)
        assert got == _plain(_hex(words), 12)[0]


def test_rounds_equal_single_merges():
    """The rounds' rule itself on many random inputs: pieces between rare pairs have all that merges above the floor depend on."""
    rng = random.Random(1)
    for _ in range(400):
        words = _hex(_run_heavy(rng))
        own, found, known = [list(t) for t, _ in words], [], set()
        while len(found) < 40:
            counts = Counter()
            for t, (_, n) in zip(own, words):
                for p in zip(t, t[1:]):
                    counts[p] += n
            width = rng.randint(1, 6)
            top = sorted(((a, b, n) for (a, b), n in counts.items()), key=lambda x: (x[2], x[:2]), reverse=True)[: width + 1]
            if not top:
                break
            floor = top[width][2] if len(top) > width else 0
            frequent, most = {x[:2] for x in top if x[2] > floor}, 40 - len(found)
            if not frequent:
                frequent, most, floor = {top[0][:2]}, 1, 0
            pieces = Counter()
            for t, (_, n) in zip(own, words):
                a = 0
                for k in range(1, len(t) + 1):
                    if k == len(t) or (t[k - 1], t[k]) not in frequent:
                        pieces[tuple(t[a:k])] += n
                        a = k
            new = merging.next_merges([(list(t), n) for t, n in pieces.items()], most, floor, known)
            found += new
            known |= {a + b for a, b, _ in new}
            own = [merging.replay(t, {m[:2]: k for k, m in enumerate(new)}) for t in own]
        want, tokens = _plain(words, 40)
        assert found == want and own == tokens


def test_ten_thousand_merges(spark):
    """A production number of merges on whole documents, and their encoding, equal to plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = [(r.word, r.cnt) for r in bpe.word_freqs(docs).collect()]
    got = bpe.train(bpe.word_sequences(spark.createDataFrame(words, "word string, cnt long")), 10_000)
    want, _ = _plain(_hex(words), 10_000)
    assert got == want and len(got) > 5000
    vocab = bpe.vocabulary(spark, got)
    ids = {bytes.fromhex(t): i for i, t in ((r.id, r.tok) for r in vocab.orderBy("id").collect())}
    ranks = {(a, b): k for k, (a, b, _) in reversed(list(enumerate(got)))}

    def plain(word):
        t = [f"{x:02X}" for x in word.encode()]
        while len(t) > 1:
            rank, k = min((ranks.get(p, 10**9), k) for k, p in enumerate(zip(t, t[1:])))
            if rank == 10**9:
                break
            t = [*t[:k], t[k] + t[k + 1], *t[k + 2 :]]
        return [ids[bytes.fromhex(x)] for x in t]

    few = docs.orderBy("doc_id").limit(25)
    known = {w: plain(w) for w, _ in words}
    split = {r.doc_id: [x.word for x in sorted(r.w)] for r in bpe.pretokenize(few).selectExpr("doc_id", "struct(pos, word) as x").groupBy("doc_id").agg({"x": "collect_list"}).toDF("doc_id", "w").collect()}
    encoded = bpe.encoded_arrays(few, got, vocab)
    assert {r.doc_id: r.ids for r in encoded.collect()} == {d: [i for w in ws for i in known[w]] for d, ws in split.items()}
    assert {r.doc_id: r.text for r in bpe.decode(encoded, vocab).collect()} == {r.doc_id: r.text for r in few.collect()}


def test_encode_is_greedy_by_rank():
    rng = random.Random(6)
    for _ in range(500):
        ranks = {}
        for k in range(rng.randint(0, 12)):
            x = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) for _ in range(2)]
            ranks.setdefault(tuple(x), k)
        word = [rng.choice("ab") for _ in range(rng.randint(0, 20))]
        want = list(word)
        while len(want) > 1:
            rank, k = min((ranks.get(p, 99), k) for k, p in enumerate(zip(want, want[1:])))
            if rank == 99:
                break
            want[k : k + 2] = [want[k] + want[k + 1]]
        assert merging.encode(word, ranks) == want


def test_long_words_and_edge_cases(spark):
    """A word of 200,000 equal characters is encoded in near linear work; null, empty and special texts; a hot word."""
    merges = [("61", "61"), ("6161", "6161"), ("62", "61")]
    vocab = bpe.vocabulary(spark, merges)
    texts = [None, "", "a" * 200_001, "ba", SPECIALS[0] * 3, f"x{SPECIALS[1]}", "the " * 2000]
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, ids int")
    e = bpe.encoded_arrays(docs, merges, vocab)
    got = {r.doc_id: r.ids for r in e.collect()}
    assert got[0] == got[1] == [] and got[2] == [261] * 50_000 + [97] and got[3] == [262] and got[4] == [256] * 3 and got[5] == [120, 257]
    assert {r.doc_id: r.text for r in bpe.decode(e, vocab).collect()} == {k: t or "" for k, t in enumerate(texts)}
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert bpe.encoded_arrays(docs.limit(0), merges, vocab).count() == 0


def test_pair_index(spark, tmp_path):
    words = [("aab", 3), ("abab", 1), ("b", 5), ("éa", 2), ("", 1)]
    df = bpe.word_sequences(spark.createDataFrame(words, "word string, cnt long"))
    bpe.write_pair_index(df, str(tmp_path / "index"))
    for pair in [("61", "62"), ("62", "61"), ("A9", "61"), ("00", "00")]:
        got = sorted((r.word, r.cnt) for r in bpe.words_with(spark, str(tmp_path / "index"), pair).collect())
        assert got == sorted((w, n) for w, n in words if bytes.fromhex("".join(pair)) in w.encode())
