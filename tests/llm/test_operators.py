"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import contamination, fingerprints, language, lines, packing, pii, repeats, similarity, store, token_files, toxicity
from tests.llm.brute import closed, components, edit_distance, fuzzy_groups, line_forms, shingles, windows_hit

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


def test_fingerprints(docs, texts, empty):
    got = sorted(fingerprints.fingerprints(docs).collect(), key=lambda r: r.doc_id)
    parts = lambda x: {p.strip(" ") for p in x.split("\n") if p.strip(" ")}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, t) in enumerate(texts):
        t, nxt = t or "", texts[(k + 1) % len(texts)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[k]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (i, len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(parts(t), parts(edited))) and r.near_next == pytest.approx(like(parts(t), parts(nxt)))
    assert got[5].fingerprint == got[6].fingerprint != got[7].fingerprint
    assert fingerprints.fingerprints(empty).count() == 0
    one = fingerprints.fingerprints(docs.where("doc_id = 5")).first()
    assert one.near_next == 1.0
    twice = fingerprints.fingerprints(docs.where("doc_id = 5").union(docs.where("doc_id = 5")))
    assert twice.count() == 2


def test_sentences_of_one_line_are_pieces(spark):
    a = "One two three. Four five! Six seven? Eight nine."
    df = spark.createDataFrame([(1, a), (2, a.replace("Four", "Ten"))], "doc_id long, text string")
    assert [(r.n_pieces, r.near_next) for r in fingerprints.fingerprints(df).collect()] == [(4, pytest.approx(3 / 5))] * 2


def test_larger_retry_finds_all(spark):
    rng = random.Random(1)
    a = [rng.getrandbits(62) for _ in range(700)]
    b = a[300:] + [rng.getrandbits(62) for _ in range(500)]
    df = spark.createDataFrame([(a, b), ([], []), (a, a)], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in df.selectExpr(fingerprints.larger_difference("a", "b")).collect()] == [800, 0, 0]


def _brute_repeats(rows, n=100):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if b[s : s + n] in seen:
                gone[s : s + n] = b"\1" * n
            seen.add(b[s : s + n])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(docs, texts, empty):
    rows = [x for x in texts if len(x[1] or "") < 20_000]
    got = sorted(tuple(r)[:5] for r in repeats.remove_repeats(docs.where("text is null or length(text) < 20000")).collect())
    assert got == _brute_repeats(rows)
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_of_runs_and_of_hot_triggers(spark):
    """Runs of one byte or of two have a trigger at each; one passage stands between ever other words; rows repeat."""
    rng = random.Random(17)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(40))
    rows = [(1, "x" * 3000), (2, "y" * 150 + "x" * 500 + "y" * 150), (3, "ab" * 700), (4, "b" + "ab" * 60), (5, "z" * 99), (6, "z" * 100), (7, "z" * 101)]
    rows += [(10 + k, "".join(rng.choice("klmn") for _ in range(rng.randint(20, 90))) + passage + "".join(rng.choice("pq") for _ in range(rng.randint(20, 90)))) for k in range(60)]
    rows += [(200 + k, rows[7 + k][1][:110] + "é") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r)[:5] for r in repeats.remove_repeats(df).collect()) == _brute_repeats(rows)


def test_phrases_and_parse_rank_windows():
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 99, (300, 168)).astype(np.uint8)
    rows[100:200] = rows[:100]
    rows[100:200, :30] = 97
    rank, common = repeats.suffix_array(rows)
    order = np.argsort(rank)
    assert [rows[k].tobytes() for k in order] == sorted(r.tobytes() for r in rows)
    e, o, m, d, p = repeats.first_windows(rows, np.zeros(300, np.int64), np.full(300, 168), np.arange(300), np.full(300, 1000), 100)
    seen = {}
    for k in range(300):
        for s in range(69):
            seen.setdefault((s, rows[k, s : s + 100].tobytes()), (k, 1000 - 68 + s))
    got = {(a, b + i): (x, y + i) for a, b, n, x, y in zip(e.tolist(), o.tolist(), m.tolist(), d.tolist(), p.tolist()) for i in range(n)}
    assert got == {(k, s): seen[s, rows[k, s : s + 100].tobytes()] for k in range(300) for s in range(69)}


def test_token_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 4000):
        for top in (1, 2, 50_000, 2**32 - 1):
            x = rng.integers(0, top, n, endpoint=True).astype(np.uint32)
            x[rng.random(n) < 0.02] = 2**32 - 1
            raw = token_files.pack(x)
            assert (token_files.unpack(raw) == x).all()
            assert (token_files.unpack(raw, 1, 2) == x[128:256]).all()


def test_token_files(docs, texts, empty):
    path = public.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    at, want = 0, []
    for i, x in texts:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files.token_files(docs, path).collect())) == want
    assert token_files.token_files(empty, path).count() == 0


def test_packing(docs, texts, empty, spark):
    path = public.path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    got = packing.best_fit_packing(docs, path).collect()
    for i, x in texts:
        ids, at = [*t.encode(x or "", add_special_tokens=False).ids, 0], 0
        for k, p in enumerate(sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)):
            assert (p.piece, p.start, p.ids_crc32) == (k, at, zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes()))
            assert p.length == 2048 or k == 0
            at += p.length
        assert at == len(ids)
    _whole(got, 2048)
    assert packing.best_fit_packing(empty, path).count() == 0


def _whole(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing_is_near_the_bound(spark):
    rng = random.Random(3)
    sizes = [rng.choice([rng.randint(1, 60), rng.randint(1, 200), 77, 120]) for _ in range(4000)]
    df = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(sizes)], packing.PIECES)
    got = packing.pack_pieces(df, store.Scratch(spark, "t"), 200, 24, 25).collect()
    assert len(got) == 4000 and _whole(got, 200) <= 1.1 * max(sum(sizes) / 200, sum(n > 100 for n in sizes))
    sizes = [min(2048, int(rng.paretovariate(1.1) * 60)) for _ in range(6000)]  # a production capacity, lengths like those of documents
    df = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(sizes)], packing.PIECES)
    got = packing.pack_pieces(df, store.Scratch(spark, "t2"), 2048).collect()
    assert len(got) == 6000 and _whole(got, 2048) <= 1.01 * max(sum(sizes) / 2048, sum(n > 1024 for n in sizes)) + 1


def test_toxicity(spark, docs, empty):
    rng = random.Random(2)
    clean = ["the", "of", "river", "stone", "garden", "morning", "window", "paper", "light", "quiet"]
    rows, labels = [], []
    for k in range(600):
        w = [rng.choice(clean) for _ in range(rng.randint(5, 80))]
        bad = k % 4 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["vrelk", "vrelking", "vrelkus"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(d, lab).collect()}
    assert {k for k, r in got.items() if r.held_out} == {k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0}
    held = [k for k, r in got.items() if r.held_out]
    assert sum(got[k].predicted == labels[k][1] for k in held) / len(held) > 0.97
    assert toxicity.score_documents(docs, lab.limit(0)).count() == docs.count()
    assert toxicity.score_documents(empty, lab).count() == 0
    left = toxicity.reject_toxic(d, lab)
    assert left.columns == d.columns and abs(left.count() - 450) < 15


def test_scores_add_the_weights_of_a_texts_grams(spark):
    """Against sets of n-grams in plain Python, with repeated rows, nulls and long texts in the sample."""
    rng = random.Random(21)
    rows = [(k, " ".join(rng.choice(["alpha", "Beta!", "gämma", "délta", "vrelk" if k % 3 == 0 else "omega"]) for _ in range(rng.randint(3, 900 if k == 9 else 30)))) for k in range(200)]
    df = spark.createDataFrame([*rows, *rows[:40], (500, None), (None, "vrelk")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows] + [(500, 0), (None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    assert len(model.keys) and toxicity.train(df, labels).weights.tolist() == model.weights.tolist()
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    table = {}

    def slots(text):
        text = " " + "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in text)
        found = set()
        for n in toxicity.GRAMS:
            for g in {text[i : i + n] for i in range(len(text) - n + 1)}:
                if g not in table:
                    raw = np.frombuffer(g.encode(), np.uint8)
                    table[g] = int(toxicity.grams(raw, np.array([0, len(raw)]), n)[0][0])
                found.add(table[g])
        return found

    for r in toxicity.score_documents(df, labels).collect():
        t = "vrelk" if r.doc_id is None else dict(rows).get(r.doc_id, "")
        total = model.bias + sum(weight.get(x, 0.0) for x in slots(t))
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9) and r.predicted == int(r.score >= 0.5)


def test_language(spark, docs, empty):
    rng = random.Random(4)
    vocab = {"en": ["the", "house", "with", "night", "which"], "de": ["das", "haus", "mit", "nacht", "über"], "fr": ["la", "maison", "avec", "nuit", "été"]}
    text = lambda c, n: " ".join(rng.choice(vocab[c]) for _ in range(n))
    d = spark.createDataFrame([(k, text(c, 40), c) for k, c in enumerate(["en", "de", "fr"] * 20)], "doc_id long, text string, lang string")
    rows = [(k, f"https://{c}{k % 4}.site.{'com' if k % 3 else c}/x", f"<html lang='{c}-X'><style>p</style><p>{text(c, 30)}</p></html>", c) for k, c in enumerate(["en", "de", "fr"] * 20)]
    rows += [(100, "https://de1.site.de/q", "<html><p></p></html>", "de"), (101, None, None, None), (102, "nonsense", "", None)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string, source string")
    got = {r.page_id: r for r in language.identify(p, d).collect()}
    assert all(got[k].lang == c for k, _, _, c in rows if c) and len(got) == len(rows)
    assert all(0 <= r.probability <= 1 + 1e-9 for r in got.values())
    assert language.identify(p.limit(0), d).count() == 0
    assert language.identify(p, empty).count() == len(rows)


def test_declared_language_after_a_long_preamble(spark):
    late = "<!-- <html lang='xx'> " + "licence " * 1000 + "-->" + " " * 3000 + "<script>var x = '<html lang=yy>';</script><html class='" + "c " * 3000 + "' lang='de'>"
    df = spark.createDataFrame([(late,), ("<html lang=fr>",), ("<p lang='it'>",), (None,)], "html string")
    assert [r[0] for r in df.select(language.declared_language("html")).collect()] == ["de", "fr", "", ""]


def test_language_of_entities_hot_hosts_and_many_codes(spark, monkeypatch):
    texts = {"fr": "la soir&eacute;e d&#39;&eacute;t&eacute; &agrave; l&#x2019;&eacute;cole", "en": "the evening of the summer at school"}
    plain = {"fr": "la soirée d'été à l’école", "en": texts["en"]}
    d = spark.createDataFrame([(k, (plain[c] + " ") * 10, c) for k, c in enumerate(["en", "fr"] * 20)], "doc_id long, text string, lang string")
    assert language.decoded(pa.array([texts["fr"], None, "a"], pa.string())).to_pylist() == [plain["fr"], None, "a"]
    rows = [(k // 2, "https://www.shop.co.uk/a" if k % 3 else f"https://h{k}.example.fr", f"<p>{texts['fr' if k % 2 else 'en']}</p>", "x", "y") for k in range(60)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string, host string, w string").repartition(4)
    got = language.identify(p, d).collect()
    assert len(got) == 60 and sorted(r.lang for r in got) == ["en"] * 30 + ["fr"] * 30
    long = spark.createDataFrame([(1, "https://a.b", "<p>" + (texts["fr"] + " ") * 40_000 + "</p>")], "page_id long, url string, html string")
    assert language.identify(long, d).first().lang == "fr"
    names = spark.createDataFrame([("a.shop.co.uk",), ("shop.co.uk",), ("x.example.fr",), ("localhost",), ("co.uk",)], "host string")
    assert [r[0] for r in names.select(language.domain_of("host")).collect()] == ["shop.co.uk", "shop.co.uk", "example.fr", "localhost", "co.uk"]
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    odd = spark.createDataFrame([(900 + k, "zzz qqq xxx " * 20, c) for k, c in enumerate(["aa", "bb", "cc", "cc"])], "doc_id long, text string, lang string")
    assert language.fit(d.unionByName(odd))[0] == ["en", "fr", "other"]
    got = language.identify(p, d.unionByName(odd)).collect()
    assert sorted(r.lang for r in got) == ["en"] * 30 + ["fr"] * 30
    page = spark.createDataFrame([(1, "https://a.b", "<p>" + "qqq zzz " * 30 + "</p>")], "page_id long, url string, html string")
    assert language.identify(page, d.unionByName(odd)).first().lang == "other"


def test_contamination(spark, docs, texts, empty, monkeypatch):
    passage = texts[9][1].split("\n")[0].split()
    items = [(0, " ".join(passage[5:30])), (1, "one TWO, three. four"), (2, None), (3, "..."), (4, " ".join(passage[20:45])), (5, "a"), (6, "no such words anywhere at all"), (6, " ".join(passage[1:14]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in contamination.contamination(docs, bench).collect()}
    for i, t in texts:
        n, hit, own = windows_hit(t, items)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(own), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest()
    left = contamination.remove_contamination(docs, bench)
    assert left.columns == docs.columns
    assert not [r for r in contamination.contamination(left, bench).collect() if r.n_hit and r.doc_id in (9, 10)]
    assert {r.doc_id: r.text for r in left.collect()}[5] == texts[5][1]
    assert contamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert contamination.contamination(empty, bench).count() == 0
    # blocks of one or two items are a pass each, with the same rows
    want = sorted(map(repr, contamination.contamination(docs, bench).collect()))
    cut = sorted(map(repr, left.collect()))
    monkeypatch.setattr(contamination, "BLOCK_BYTES", 20)
    assert sorted(map(repr, contamination.contamination(docs, bench).collect())) == want
    assert sorted(map(repr, contamination.remove_contamination(docs, bench).collect())) == cut
    # an item without an id hits words, but is not listed; repeated documents are judged each
    nameless = spark.createDataFrame([(None, "one two three four"), (7, "one two three four"), (7, "one two three four")], "item_id long, text string")
    got = [r for r in contamination.contamination(docs.unionByName(docs), nameless).collect() if r.contaminated]
    assert got and len(got) % 2 == 0 and all(r.item_ids == ["7"] for r in got)
    alone = contamination.contamination(docs, nameless.where("item_id is null")).where("contaminated").collect()
    assert len(alone) == len(got) / 2 and all(r.n_items == 0 and r.n_hit for r in alone)


def test_index_counts_and_places():
    rng = np.random.default_rng(3)
    symbols = rng.integers(1, 4, 400)
    cuts = np.array([0, 17, 200])
    index = contamination.FMIndex(symbols, cuts, 3)
    windows = np.array([[1, 2, 3], [2, 2, 2], [3, 1, 1]])
    who, lo, hi = index.search(windows)
    for k, w in enumerate(windows):
        want = [i for i in range(398) if (symbols[i : i + 3] == w).all() and not any(i < c < i + 3 for c in cuts)]
        at = np.flatnonzero(who == k)
        got = sorted(index.locate(np.arange(lo[at[0]], hi[at[0]]))) if len(at) else []
        assert [int(index.place[i]) for i in want] == [int(x) for x in got]


def test_pii(spark, docs, empty):
    text = ["card 4111111111111111 or 4111 1111 1111 1111 not 4111111111111112", "+1 (017) 555-7713, +49 30 123456", "123-45-6789 000-12-3456", "192.168.0.1 256.1.1.1 1.2.3.4.5", "2020-02-29 2019-02-29 29.02.2020 2199/12/31 1800-01-01", "und.34@mail7.example.com", "", None, "4111111111111111"]
    df = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    out = pii.pseudonymize(df, "k")
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].pii_kinds == ["card", "card"] and "4111111111111112" in got[0].text
    luhn = lambda s: sum((d * 2 - 9 * (d > 4) if k % 2 else d) for k, d in enumerate(int(c) for c in reversed(re.sub(r"\D", "", s)))) % 10 == 0
    assert all(map(luhn, got[0].pii_pseudonyms)) and got[0].pii_pseudonyms[0] == got[8].pii_pseudonyms[0]
    assert len(got[1].pii_kinds) == 2 and got[2].pii_kinds == ["ssn"] and got[3].pii_kinds == ["ip"] and got[4].pii_kinds == ["date"] * 4
    assert got[5].text.endswith("@mail7.example.com") and re.fullmatch(r"[a-z]{3}\.[0-9]{2}@.*", got[5].text) and got[5].text != text[5]
    assert got[7].text is None
    back = {r.doc_id: r.text for r in pii.pseudonymize(out.select("doc_id", "text"), "k", invert=True).collect()}
    assert back == dict(enumerate(text))
    other = pii.pseudonymize(df, "another").where("doc_id = 0").first()
    assert other.text != got[0].text
    assert pii.pseudonymize(empty, "k").count() == 0 and pii.pseudonymize(docs, "k").count() == docs.count()
    days = spark.range(0, 146097, 37).selectExpr("date_format(date_add(date'1800-01-01', cast(id as int)), 'yyyy-MM-dd') as text", "id as doc_id")
    assert pii.pseudonymize(days, "k").select("text").distinct().count() == days.count()


def test_compact_phone_numbers(spark):
    df = spark.createDataFrame([(1, "+12025550123 or +4930123456789, +353861234567; not +0123456789")], "doc_id long, text string")
    got = pii.pseudonymize(df, "k")
    r = got.first()
    assert r.pii_kinds == ["phone"] * 3 and r.pii_values == ["+12025550123", "+4930123456789", "+353861234567"]
    for old, new, code in zip(r.pii_values, r.pii_pseudonyms, ("+1", "+49", "+353"), strict=True):
        assert new != old and new.startswith(code) and re.fullmatch(r"[+][0-9]+", new) and len(new) == len(old)
    assert pii.pseudonymize(got.select("doc_id", "text"), "k", invert=True).first().text == df.first().text


def test_national_phone_numbers(spark):
    df = spark.createDataFrame([(1, "call (555) 123-4567 or 555-123-4567 or 555.123.4567, not 1555-123-45678 nor 555-1234-567")], "doc_id long, text string")
    got = pii.pseudonymize(df, "k")
    r = got.first()
    assert r.pii_kinds == ["phone"] * 3 and r.pii_values == ["(555) 123-4567", "555-123-4567", "555.123.4567"]
    assert len({re.sub("[^0-9]", "", x) for x in r.pii_pseudonyms}) == 1  # one number, in any form
    assert [re.sub("[0-9]", "0", x) for x in r.pii_pseudonyms] == ["(000) 000-0000", "000-000-0000", "000.000.0000"]
    assert pii.pseudonymize(got.select("doc_id", "text"), "k", invert=True).first().text == df.first().text


def test_pii_of_very_long_texts_and_the_key_stays_out_of_plans(spark):
    long = "ab.C9" * 20_000
    rows = [(1, "a@" + "a." * 100_000), (2, long + "@example.com tail"), (3, "x@" * 50_000), (4, "+1 " * 30_000 + "4" * 50_000), (5, "mail a.b@c.com. end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'v' as _values", "'n' as _new", "'k' as _key", "'p' as pii_kinds")
    out = pii.pseudonymize(df, "very secret key")
    got = {r.doc_id: r for r in out.collect()}
    new = got[2].text
    assert len(new) == len(rows[1][1]) and new.endswith("@example.com tail") and new != rows[1][1]
    assert re.sub("[a-z]", "a", re.sub("[0-9]", "9", new)) == re.sub("[a-z]", "a", re.sub("[0-9]", "9", rows[1][1])).replace("C", new[3]) or re.fullmatch(r"(?:[a-z]{2}\.[A-Z][0-9])+@example\.com tail", new)
    assert [got[k].text for k in (1, 3, 4)] == [rows[k - 1][1] for k in (1, 3, 4)]
    assert got[5].pii_values == ["a.b@c.com"] and got[5].text.endswith("@c.com. end") and (got[5]._values, got[5]._key) == ("v", "k")
    assert "very secret key" not in out._jdf.queryExecution().toString()
    back = pii.pseudonymize(out.select("doc_id", "text"), "very secret key", invert=True)
    assert {r.doc_id: r.text for r in back.collect()} == dict(rows)


def test_similarity(spark, docs, texts, empty):
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 99999)}" for _ in range(120)]
    rows = list(texts)
    for k in range(150):  # a cloud of near copies
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(120)] = f"n{rng.randint(0, 99999)}"
        rows.append((100 + k, " ".join(w)))
    rows += [(5, texts[5][1]), (400, texts[5][1])]
    df = spark.createDataFrame([(i, t, "p") for i, t in rows], "doc_id long, text string, part string")
    sets = {i: shingles(t) for i, t in rows}
    want = components(sets)
    got = similarity.similar_components(df).collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]) for r in got)
    assert similarity.similar_components(empty).count() == 0
    assert {r.doc_id for r in similarity.keep_one_of_each(df).collect()} == {i for i in sets if want[i] == i}


def test_hot_texts_in_descending_order_keep_their_near_copies(spark):
    base = " ".join(f"w{k}" for k in range(60))
    near = [base.replace("w30 ", f"new{k} ") for k in range(3)]
    rows = [(100 - k, base) for k in range(70)] + [(3 - k, t) for k, t in enumerate(near)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.component_id for r in similarity.similar_components(df).collect()} == {1}


def test_split_blocks_lose_no_link(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 99999)}" for _ in range(60)]
    rows = []
    for k in range(60):
        w = list(base)
        w[rng.randrange(60)] = f"n{k}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(similarity, "BLOCK_SETS", 7)
    got = {r.doc_id: r.component_id for r in similarity.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components({i: shingles(t) for i, t in rows})


def test_lines(spark):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randint(0, 999)}" for _ in range(400))
    near = [" ".join(["zz"] + long.split()[1:]) if k == 0 else long.replace(long.split()[k * 7], "q", 1) for k in range(12)]
    rows = [(0, "Same line!\nother one\n\n---"), (1, "same LINE\nmore\n---"), (2, None), (3, ""), (4, long + "\n" + near[0])] + [(10 + k, near[k] + f"\nown {k} {rng.random()}") for k in range(12)] + [(3, ""), (40, "b a c\na b c\nc b a"), (50, "की\nका"), (None, "no id at all, same line\nSame line"), (None, "No id, at all same line")]
    clash = ["line", "did", "tid", "gone", "pos", "n_lines", "kept_text", "c0", "_gone", "id"]
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").selectExpr("*", *[f"'x' as {c}" for c in clash])
    low = -(1 << 63)
    tie = {t: spark.sql("select xxhash64(:t)", args={"t": t}).first()[0] for i, t in rows if i is None}
    occ = [(low if i is None else i, p, tie.get(t, 0), f) for i, t in rows if t is not None for p, f in enumerate(line_forms(t)) if f]
    group = fuzzy_groups(sorted({f for *_, f in occ}))
    first, gone = {}, {}
    for i, p, t, f in sorted(occ):
        if first.setdefault(group[f], (i, p, t)) != (i, p, t):
            gone.setdefault((i, t), set()).add(p)
    out = lines.fuzzy_line_dedup(df)
    assert sorted(out.columns) == sorted(df.columns + ["n_removed"])
    left = sorted((repr(r.doc_id), repr(r.kept_text), r.n_removed, r.did, r.c0) for r in out.collect())
    want = []
    for i, t in rows:
        lost = gone.get((low if i is None else i, tie.get(t, 0)), ()) if t is not None else ()
        want.append((repr(i), repr(t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in lost)), len(lost), "x", "x"))
    assert left == sorted(want)
    assert lines.fuzzy_line_dedup(df.limit(0)).count() == 0
    assert (50, 0) not in gone  # vowel signs tell lines apart


def _groups(spark, forms):
    """The component of each form by like_lines; its own place if it has none."""
    keyed = spark.createDataFrame([(f,) for f in forms], "form string").repartition(8).selectExpr("form", "xxhash64(form) as id", "unhex(md5(form)) as line")
    found = lines.like_lines(keyed, store.Scratch(spark, "lines"))
    got = {bytes(r.line): bytes(r.component) for r in found.collect()}
    return [got.get(hashlib.md5(f.encode()).digest(), k) for k, f in enumerate(forms)]


def _edited(rng, form, kind):
    w = form.split(" ")
    if kind == "letters":
        c = list(form)
        for i in rng.sample(range(len(c)), max(1, len(c) // 25)):
            c[i] = rng.choice("aeiou")
        return " ".join("".join(c).split())
    for i in rng.sample(range(len(w)), 1 if kind == "word" else max(1, len(w) // 8)):
        w[i] = "".join(rng.choice("bdgkz") for _ in range(5))
    return " ".join(w)


def test_line_search_finds_most_similar_pairs(spark):
    """Against the edit similarity of all pairs, without any search condition."""
    rng = random.Random(12)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    forms = sorted({f for r in docs for f in line_forms(r.text or "") if 5 <= len(f) <= 1200})
    kinds = ("word", "eighth", "letters")
    forms = rng.sample(forms, min(400, len(forms)))
    forms = sorted({*forms, *(_edited(rng, f, kinds[k % 3]) for k, f in enumerate(forms))})
    df = spark.createDataFrame(list(enumerate(forms)), "i long, x string").repartition(8)
    pairs = df.join(df.selectExpr("i as j", "x as y"), F.expr("i < j and least(length(x), length(y)) >= 0.79 * greatest(length(x), length(y))"))
    pairs = [tuple(r) for r in pairs.where("levenshtein(x, y, cast(floor(greatest(length(x), length(y)) * 0.2D + 1e-9D) as int)) >= 0").select("i", "j").collect()]
    group = _groups(spark, forms)
    for low, high in ((5, 48), (48, 100), (100, 250), (250, 2000)):
        some = [(i, j) for i, j in pairs if low <= len(forms[i]) < high]
        assert len(some) > 20 and sum(group[i] == group[j] for i, j in some) >= 0.9 * len(some)


def test_line_search_takes_long_words_and_very_long_lines(spark):
    rng = random.Random(14)
    word = "".join(rng.choice("abcdefgh") for _ in range(300))
    many = [f"w{rng.randint(0, 10**6)}" for k in range(16_000)]
    near = [f"z{k}" if k % 900 == 7 else w for k, w in enumerate(many)]
    some = many[:900]
    forms = [word, word[:150] + "zz" + word[151:], " ".join(many), " ".join(near), " ".join(some), " ".join(rng.sample(some, len(some)))]
    group = _groups(spark, forms)
    assert group[0] == group[1] != group[2] == group[3] != group[4]
    assert group[4] != group[5]  # the same words in another order are far apart, at any length


def test_crowded_blocks_lose_no_link(spark):
    """Many forms share most features; the links of those that are unlike the block's first form stay."""
    rng = random.Random(15)
    base = [f"word{k}{rng.choice('abc')}" for k in range(40)]
    forms = []
    for k in range(150):
        w = list(base)
        for i in rng.sample(range(40), k // 25):
            w[i] = "".join(rng.choice("bdgkz") for _ in range(7))
        forms.append(" ".join(w))
    forms = sorted(set(forms))
    group = _groups(spark, forms)
    want = closed(list(range(len(forms))), lambda a, b: lines.alike(forms[a], forms[b]))
    for k in want:
        assert (group[k] == group[want[k]]) or want[k] == k


def test_edit_distance():
    rng = random.Random(16)
    for _ in range(400):
        a, b = ("".join(rng.choice("abé ") for _ in range(rng.randint(0, 15))) for _ in range(2))
        d = edit_distance(a, b)
        assert [lines.distance(a, b, m) for m in (0, 2, 6, 20)] == [min(d, m + 1) for m in (0, 2, 6, 20)]


def test_chains_of_lines_with_one_word_in_most_places(spark):
    """Each is like the next ones only; one word is over half of every line, so whole-word SimHashes are equal."""
    rng = random.Random(13)
    forms = []
    for _ in range(6):
        old, new = (["".join(rng.choice(s) for _ in range(6)) for _ in range(5)] for s in ("abcdef", "uvwxyz"))
        forms.append([" ".join(["0"] * 7 + new[:k] + old[k:]) for k in range(6)])
    group = _groups(spark, [f for chain in forms for f in chain])
    assert [len(set(group[6 * k : 6 * k + 6])) for k in range(6)] == [1] * 6 and len(set(group)) == 6


def test_components(spark):
    rng = random.Random(10)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    top = {}
    for a, b in links:
        top.setdefault(a, a), top.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(top[a], top[b])
            changed |= top[a] != m or top[b] != m
            top[a] = top[b] = m
    got = {r.node: r.component for r in store.components(df, store.Scratch(spark, "c")).collect()}
    assert got == {k: v for k, v in top.items() if any(a != b and k in (a, b) for a, b in links)}


def test_pipeline_matches_its_stages_by_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    toxic, likes, grams, clean, pack = (f for _, f in corpus_pipeline.STAGES)
    a = toxic(spark, docs, d)
    scored = {r.doc_id for r in toxicity.score_documents(docs, spark.read.parquet(f"{d}/labels.parquet")).where("predicted = 0").collect()}
    assert {r.doc_id for r in a.collect()} == scored and a.columns == docs.columns
    b = likes(spark, a, d)
    kept = {r.doc_id: r.kept_text for r in lines.fuzzy_line_dedup(a).collect()}
    assert all(r.text == kept[r.doc_id] and r.n_chars == len(r.text) for r in b.collect())
    c = grams(spark, b, d)
    want = components({r.doc_id: shingles(r.text) for r in b.collect()})
    assert {r.doc_id for r in c.collect()} == {i for i, m in want.items() if i == m}
    e = clean(spark, c, d)
    bench = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    assert e.columns == docs.columns and not any(windows_hit(r.text, bench)[1] for r in e.collect())
    got = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in e.collect()}
    _whole(got, 2048)
    assert pack is not None


def test_lines_that_lost_blanks(spark):
    """Forms that differ in blanks alone meet at every length: some or all blanks lost, in crowds too."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 9)))
    base = [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 5, 9, 20, 60, 200) for _ in range(6)]
    lost = [x.replace(" ", "") for x in base] + ["".join(c for c in x if c != " " or rng.random() < 0.5) for x in base]
    crowd = " ".join(word() for _ in range(40))
    many = ["".join(c for c in crowd if c != " " or rng.random() < 0.6) for _ in range(60)]
    rows = [*base, *lost, crowd, *many]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r.doc_id: r.n_removed for r in lines.fuzzy_line_dedup(df).collect()}
    linked = lambda a, b: edit_distance(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9)
    for k, x in enumerate(base):
        for j in (len(base) + k, 2 * len(base) + k):
            assert out[j] == int(linked(x, rows[j])), (x, rows[j])
    assert sum(out[k] == 0 for k in range(3 * len(base), len(rows))) == 1


def test_language_fusion_against_plain_loops(spark):
    """Evidence, grouped counts, smoothed priors and the posterior, page by page; null labels, codes and texts among the documents."""
    rng = random.Random(21)
    vocab = {"en": ["the", "house", "with"], "de": ["das", "haus", "mit"], "fr": ["la", "maison", "avec"]}
    rows = [(k, " ".join(rng.choice(vocab[c]) for _ in range(rng.randint(0, 12))), c) for k, c in enumerate(["en", "de", "fr"] * 8)] + [(90, None, "en"), (91, "das haus", None), (92, "", "de")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pages = []
    for k in range(45):
        c = rng.choice(list(vocab))
        host = rng.choice(["a.x.de", "b.x.de", "shop.fr", "w.shop.fr", "one.com", "localhost"])
        pages.append((k, f"https://{host}/p", f"<html{rng.choice([f' lang={c}', ''])}><p>{' '.join(rng.choice(vocab[c]) for _ in range(rng.randint(0, 6)))}</p>"))
    pages += [(45, None, None), (7, "https://a.x.de", "<p>das</p>")]
    langs, weights = language.fit(d)
    assert langs == ["de", "en", "fr"]
    n = {}
    for _, t, c in rows:
        if t is not None and c is not None:
            slots = language._runs(*language.flat(pa.array([t], pa.large_string())))[0] if t else []
            for x in slots:
                n.setdefault(c, {}).setdefault(int(x), 0)
                n[c][int(x)] += 1
    for k, c in enumerate(langs):
        total = sum(n[c].values()) + 0.01 * 2**language.SLOT_BITS
        for x in list(n[c])[:20]:
            assert weights[k][x] == pytest.approx(np.log((n[c][x] + 0.01) / total))
    w32, seen = weights.astype(np.float32), []
    for i, url, page in pages:
        text = re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", page or "")).strip()
        slots = language._runs(*language.flat(pa.array([text], pa.large_string())))[0] if text else np.zeros(0, np.int64)
        e = np.array([float(w[slots].astype(float).sum()) for w in w32]) / max(1, len(slots)) * min(len(slots), language.TEXT_RUNS)
        e -= e.max()
        host = re.match(r"https://([^/]+)", url)[1] if url else ""
        declared = re.search(r"lang=(\w+)", page or "")
        seen.append({"id": i, "e": e, "w": np.exp(e) / np.exp(e).sum(), "declared": declared[1] if declared else "", "suffix": host.rsplit(".", 1)[-1] if "." in host else "", "domain": ".".join(host.split(".")[-2:]), "host": host})
    total = sum(p["w"] for p in seen)
    sums = {by: {v: sum(p["w"] for p in seen if p[by] == v) for v in {p[by] for p in seen}} for by in ("declared", "suffix", "domain", "host")}
    want = []
    for p in seen:
        w = p["w"]
        share = (total - w + 1) / (total.sum() - 1 + 3)
        domain = (sums["domain"][p["domain"]] - w + language.DOMAIN_WEIGHT * share) / (sums["domain"][p["domain"]].sum() - 1 + language.DOMAIN_WEIGHT)
        prior = (sums["host"][p["host"]] - w + language.HOST_WEIGHT * domain) / (sums["host"][p["host"]].sum() - 1 + language.HOST_WEIGHT)
        log = p["e"] + np.log(np.maximum(prior, 1e-9))
        for by in ("declared", "suffix"):
            log = log + np.log((np.maximum(sums[by][p[by]] - w, 0) + language.SMOOTHING) / (total - w + language.SMOOTHING * len(sums[by])))
        best = int(np.argmax(log))
        want.append((p["id"], langs[best], round(float(1 / np.exp(log - log[best]).sum()), 6), langs[int(np.argmax(p["e"]))], p["declared"], p["suffix"], p["host"]))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = [(r.page_id, r.lang, round(r.probability, 6), r.text_lang, r.declared, r.suffix, r.host) for r in language.identify(df, d).collect()]
    assert [x[:2] + x[3:] for x in sorted(got)] == [x[:2] + x[3:] for x in sorted(want)]
    assert [x[2] for x in sorted(got)] == pytest.approx([x[2] for x in sorted(want)], abs=1e-4)


def test_token_files_and_packing_of_repeated_and_missing_ids(spark):
    """Rows with one doc_id, or none, are each written, packed and scored."""
    rows = [(None, "no id"), (None, None), (5, "five words stand right here"), (5, "five words stand right here"), (5, "another text"), (1, ""), (1, "x " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = public.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    got = token_files.token_files(df, path).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want = [(i, len(ids), crc(ids)) for i, x in rows for ids in [[*t.encode(x or "", add_special_tokens=False).ids, 2]]]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=key) == sorted(want, key=key)
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert [a for a, _ in spans] == np.concatenate([[0], np.cumsum([n for _, n in spans])[:-1]]).tolist()
    assert [r.doc_id or 0 for r in sorted(got, key=lambda r: r.start)] == sorted(i or 0 for i, _ in rows)
    path = public.path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    packed = packing.best_fit_packing(df, path).collect()
    assert sum(r.length for r in packed) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in rows)
    _whole(packed, 2048)
    scored = toxicity.score_documents(df, spark.createDataFrame([(5, 1), (1, 0), (None, 1), (5, 1)], "doc_id long, toxic int")).collect()
    assert len(scored) == len(rows) and len({r.score for r in scored if r.doc_id == 5}) <= 2 and all(0 <= r.score <= 1 for r in scored)


def test_toxicity_sample_is_bounded_by_bytes(spark, monkeypatch):
    """Texts beyond the bound are left out by their hash order before they come to a task; the first one always stays."""
    rows = [(k, ("vrelk bad " if k % 2 else "river stone ") * (400 if k % 7 == 0 else 10)) for k in range(300)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    sizes = {}
    for most in (1, 6_000, 64 << 20):
        monkeypatch.setattr(toxicity, "SAMPLE_BYTES", most)
        sizes[most] = len(toxicity.train(d, lab).keys)
        got = toxicity.score_documents(d, lab).collect()
        assert len(got) == 300 and all(0 <= r.score <= 1 for r in got)
    assert sizes[1] <= sizes[6_000] <= sizes[64 << 20]


def test_pipeline_of_odd_and_of_empty_tables(spark, docs, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, extra columns of clashing names; empty tables."""
    odd = docs.unionByName(docs.where("doc_id in (5, 6)")).unionByName(docs.limit(1).selectExpr("cast(null as bigint) as doc_id", "cast(null as string) as text", "cast(null as string) as lang", "cast(null as string) as source", "cast(null as bigint) as n_chars", *[f"cast(null as string) as {c}" for c in docs.columns[5:]]))
    labels = spark.createDataFrame([(None, 1, None), (11, 0, 1), (11, 0, 1), *[(k, None, 0) for k in range(5, 28) if k != 11]], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([("a", None), (None, "etaoin shrdlu"), ("b", "")], "item_id string, text string")
    for name, d, lab, ben in [("odd", odd, labels, bench), ("empty", docs.limit(0), labels.limit(0), bench.limit(0))]:
        at = tmp_path / name
        d.write.parquet(f"{at}/documents.parquet")
        lab.write.parquet(f"{at}/labels.parquet")
        ben.write.parquet(f"{at}/benchmark.parquet")
        now = spark.read.parquet(f"{at}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            now = f(spark, now, str(at))
            assert now.columns == docs.columns, stage
        left = now.count()
        got = corpus_pipeline.run(spark, str(at)).collect()
        assert len([r for r in got if r.piece == 0]) == left and (left > 10) == (name == "odd")
        _whole(got, 2048)
