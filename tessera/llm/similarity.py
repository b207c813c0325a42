"""Exact Jaccard self-join of documents on word shingles, by a token-group matrix.

Texts are lower-cased (A-Z) and cut into words at ASCII white space. A document's set holds the hashes
of its distinct runs of `k` words; with fewer words, its whole sequence is the one element. Documents
without words, or with null text, are empty and linked with nothing. Two documents link when
100 * |x and y| >= percent * |x or y|.

 1. Shingles are dealt out by value, packed as arrays, which shows how many sets hold each.
    Copies of very frequent texts (a bounded list) send theirs once. Only shingles of two sets or more return.
 2. A set needs ceil(t |x|) shared shingles. One with fewer is done. The others keep their shared
    shingles, rarest first, and of these the prefix that any partner's prefix must meet.
 3. Sets are grouped by their least shared shingle, which similar sets mostly have in common; a group
    is split into blocks of bounded size. The matrix of blocks and prefix shingles has a row for each
    shingle that a block's union holds, so that near copies count as one group there.
 4. Blocks that meet in a row are opened together. A set stays only if its overlap with the other
    block's token union is ceil(t |x|) at least; what is left is counted by matrix products, and each
    pair of blocks returns a spanning forest of its links, never all pairs.
 5. Components of these links by grouped aggregation.

Repeated rows link by equality of sets. Null doc_ids get a null component. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, components, parts
from .textops import LOWER, U, blob, combine, edges, flat, mix, run_hashes, slices, unblob, word_table

WORDS, PERCENT = 5, 80
#: Texts that occur more than HOT_COPIES times, the HOT_LIST most frequent of them, send their shingles once.
HOT_COPIES, HOT_LIST = 64, 50_000
SLICE_BYTES = 1 << 20
BLOCK_SETS, BLOCK_TOKENS = 1500, 1 << 20
_WORD = word_table(lambda b: b not in (0x20, 9, 10, 11, 12, 13))
_LOW48 = U((1 << 48) - 1)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents' sorted distinct shingle hashes end to end, and n + 1 offsets."""
    starts, ends = edges(data, offs, _WORD)
    h = run_hashes(LOWER[data], starts, ends)
    at = np.searchsorted(starts, offs)
    s = combine(h, k)
    out, size = [], np.zeros(len(offs) - 1, np.int64)
    for d, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if z - a >= k:
            own = np.unique(s[a : z - k + 1])
        elif z > a:
            own = mix(combine(h[a:z], z - a) + U(z - a))
        else:
            continue
        out.append(own)
        size[d] = len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(size)])


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


_SENT = "dest int, kind int, doc_id long, owner long, n long, payload binary"


def _rows(dest, kind, doc_id=None, owner=None, n=None, payload=None) -> pa.RecordBatch:
    m = len(dest)
    nulls = pa.nulls(m, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(dest, pa.int32()), pa.array(np.full(m, kind), pa.int32()), nulls if doc_id is None else doc_id, nulls if owner is None else _long(owner), nulls if n is None else _long(n), pa.nulls(m, pa.binary()) if payload is None else pa.array(payload, pa.binary())], names=["dest", "kind", "doc_id", "owner", "n", "payload"])


def _send(k: int, p: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = flat(batch.column("text"))
            names, once = batch.column("doc_id"), batch.column("sends").to_numpy(zero_copy_only=False)
            for i, j in slices(offs, SLICE_BYTES):
                tokens, at = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
                n = np.diff(at)
                sums = np.concatenate([[U(0)], np.cumsum(mix(tokens))]).astype(np.uint64)
                owner = mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64) * U(0x9FB21C651E98DF25))
                yield _rows((owner % U(p)).astype(np.int32), 0, names[i:j], owner, n)
                able = np.flatnonzero((n > 0) & once[i:j].astype(bool))
                _, first = np.unique(owner[able], return_index=True)
                sends = np.zeros(j - i, bool)
                sends[able[first]] = True
                doc = np.repeat(np.arange(j - i), n)
                on = sends[doc]
                tokens, doc = tokens[on], doc[on]
                dest = (((tokens >> U(40)) * U(p)) >> U(24)).astype(np.uint16)
                order = np.argsort(dest, kind="stable")
                tokens, doc, dest = tokens[order], doc[order], dest[order]
                if len(dest):
                    cut = np.concatenate([[0], np.flatnonzero(dest[1:] != dest[:-1]) + 1, [len(dest)]])
                    where, sent = [], []
                    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                        d = doc[a:z]
                        turn = np.concatenate([[0], np.flatnonzero(d[1:] != d[:-1]) + 1])
                        low = np.ascontiguousarray((tokens[a:z] & _LOW48).view(np.uint8).reshape(-1, 8)[:, :6]).ravel()
                        where.append(int(dest[a]))
                        sent.append(blob(owner[d[turn]], np.diff(np.append(turn, z - a)).astype(np.uint32), low))
                    yield _rows(where, 1, payload=sent)

    return send


def _count(p: int):
    """At the shingles' place: those of two sets or more go on to their sets, with the bit length of their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, tokens = [], []
        at = 0
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            on = kind == 0
            if on.any():
                yield batch.filter(pa.array(on))
            for dest, raw in zip(batch.column("dest").to_pylist(), batch.column("payload"), strict=True):
                if raw.is_valid:
                    at = dest
                    o, c, low = unblob(raw.as_buffer(), np.uint64, np.uint32, np.uint8)
                    wide = np.zeros((len(low) // 6, 8), np.uint8)
                    wide[:, :6] = low.reshape(-1, 6)
                    tokens.append(wide.view(np.uint64).ravel())
                    owners.append(np.repeat(o, c))
        if not tokens:
            return
        token, owner = np.concatenate(tokens), np.concatenate(owners)
        tokens, owners = [], []
        order = np.argsort(token)
        token = token[order]
        same = token[1:] == token[:-1]
        shared = np.zeros(len(token), bool)
        shared[1:] |= same
        shared[:-1] |= same
        token, owner = token[shared], owner[order[shared]]
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, owner = token[new], owner[new]
        if not len(token):
            return
        first = np.concatenate([[True], token[1:] != token[:-1]])
        df = np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1]
        on = df > 1
        token, owner, df = token[on] | U(at) << U(48), owner[on], df[on]
        dest = (owner % U(p)).astype(np.int64)
        order = np.argsort(dest, kind="stable")
        token, owner, df, dest = token[order], owner[order], df[order], dest[order]
        rare = np.minimum(255, np.ceil(4 * np.log2(df + 1))).astype(np.uint8)
        cut = np.concatenate([[0], np.flatnonzero(dest[1:] != dest[:-1]) + 1, [len(dest)]]) if len(dest) else [0]
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            yield _rows([int(dest[a])], 2, payload=[blob(owner[a:z], token[a:z], rare[a:z])])

    return count


_ACTIVE = "id long, n long, least long, tokens binary, prefix array<long>"


def _gather(percent: int):
    """At the sets' place: sets that enough shared shingles are left of."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, size, owners, tokens, rares = [], [], [], [], [], []
        for batch in batches:
            on = batch.column("kind").to_numpy() == 0
            docs = batch.filter(pa.array(on))
            if len(docs):
                ids.append(docs.column("doc_id").fill_null((1 << 63) - 1).to_numpy(zero_copy_only=False))
                own.append(docs.column("owner").to_numpy(zero_copy_only=False).view(np.uint64))
                size.append(docs.column("n").to_numpy(zero_copy_only=False))
            for raw in batch.column("payload"):
                if raw.is_valid:
                    o, t, r = unblob(raw.as_py(), np.uint64, np.uint64, np.uint8)
                    owners.append(o)
                    tokens.append(t)
                    rares.append(r)
        if not owners or not own:
            return
        own, ids, size = np.concatenate(own), np.concatenate(ids), np.concatenate(size)
        order = np.lexsort((ids, own))
        own, ids, size = own[order], ids[order], size[order]
        first = np.concatenate([[True], own[1:] != own[:-1]])
        own, ids, size = own[first], ids[first], size[first]
        owner, token, rare = np.concatenate(owners), np.concatenate(tokens), np.concatenate(rares)
        order = np.lexsort((token, rare, owner))
        owner, token = owner[order], token[order]
        cut = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]])
        got = np.diff(cut)
        who = np.searchsorted(own, owner[cut[:-1]])
        n = size[who]
        allowed = n - (percent * n + 99) // 100 + 1  # the prefix of the whole set, rarest first
        lone = n - got
        on = np.flatnonzero(lone < allowed)
        rows: dict[str, list] = {c: [] for c in ("id", "n", "least", "tokens", "prefix")}
        for g in on.tolist():
            t = token[cut[g] : cut[g + 1]]
            rows["id"].append(int(ids[who[g]]))
            rows["n"].append(int(n[g]))
            rows["least"].append(int(mix(t).min().view(np.int64)))
            rows["tokens"].append(np.sort(t).tobytes())
            rows["prefix"].append(t[: int(allowed[g] - lone[g])].view(np.int64))
            if len(rows["id"]) >= 2000:
                yield pa.RecordBatch.from_pydict(rows, schema=_ACTIVE_ARROW)
                rows = {c: [] for c in rows}
        if rows["id"]:
            yield pa.RecordBatch.from_pydict(rows, schema=_ACTIVE_ARROW)

    return gather


_ACTIVE_ARROW = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("tokens", pa.binary()), ("prefix", pa.list_(pa.int64()))])


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over slices of the common tokens."""
    if len(a) * len(b) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a], np.int64)
    ta, tb = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(ta, tb)
    out = np.zeros((len(a), len(b)), np.float32)
    who_a, who_b = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (a, b))
    ia, ib = np.searchsorted(common, ta), np.searchsorted(common, tb)
    ok_a, ok_b = (common[np.minimum(i, len(common) - 1)] == t if len(common) else np.zeros(len(t), bool) for i, t in ((ia, ta), (ib, tb)))
    who_a, ia, who_b, ib = who_a[ok_a], ia[ok_a], who_b[ok_b], ib[ok_b]
    oa, ob = np.argsort(ia, kind="stable"), np.argsort(ib, kind="stable")
    who_a, ia, who_b, ib = who_a[oa], ia[oa], who_b[ob], ib[ob]
    step = 2048
    for lo in range(0, len(common), step):
        m = []
        for who, i, rows in ((who_a, ia, len(a)), (who_b, ib, len(b))):
            s, e = np.searchsorted(i, [lo, lo + step])
            x = np.zeros((rows, min(step, len(common) - lo)), np.float32)
            x[who[s:e], i[s:e] - lo] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return np.rint(out).astype(np.int64)


def block_links(a: list[tuple], b: list[tuple] | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a block (b None) or between two. Members are (id, n, sorted tokens)."""
    same, b = b is None, a if b is None else b

    def qualify(x, y):
        union = np.unique(np.concatenate([t for _, _, t in y]))
        return [m for m in x if np.count_nonzero(union[np.minimum(np.searchsorted(union, m[2]), len(union) - 1)] == m[2]) >= -(-percent * m[1] // 100)]

    if not same:
        a = qualify(a, b)
        b = qualify(b, a) if a else []
    if not a or not b:
        return []
    i = _overlaps([t for _, _, t in a], [t for _, _, t in b])
    na, nb = np.array([n for _, n, _ in a]), np.array([n for _, n, _ in b])
    link = 100 * i >= percent * (na[:, None] + nb[None, :] - i)
    link &= i > 0
    if same:
        np.fill_diagonal(link, False)
    out, seen_a, seen_b = [], np.zeros(len(a), bool), np.zeros(len(b), bool)
    for s in np.flatnonzero(link.any(1)).tolist():
        if seen_a[s]:
            continue
        front = np.zeros(len(a), bool)
        front[s] = seen_a[s] = True
        if same:
            seen_b[s] = True
        while front.any():
            new_b = link[front].any(0) & ~seen_b
            seen_b |= new_b
            out += [(a[s][0], b[j][0]) for j in np.flatnonzero(new_b).tolist()]
            if same:
                seen_a |= new_b
                front = new_b
            else:
                front = link[:, new_b].any(1) & ~seen_a
                seen_a |= front
                out += [(a[s][0], a[j][0]) for j in np.flatnonzero(front).tolist()]
    return out


def _verify(percent: int):
    def members(x) -> list[tuple]:
        return [(m["id"], m["n"], np.frombuffer(m["tokens"], np.uint64)) for m in x]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for k in range(len(batch)):
                a, b = batch.column("xs")[k].as_py(), batch.column("ys")[k].as_py()
                found += block_links(members(a), None if b is None else members(b), percent)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return verify


def similar_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    spark = docs.sparkSession
    p, scratch = min(parts(spark), 65_535), Scratch(spark, "similarity")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.md5(F.col("text").cast("binary"))
    hot = own.where("text is not null").groupBy(key.alias("key")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    hot = hot.where(F.col("copies") > HOT_COPIES).orderBy(F.desc("copies"), "key").limit(HOT_LIST).select("key", "first")
    sends = own.withColumn("key", key).join(F.broadcast(hot), "key", "left").select("doc_id", "text", F.coalesce(F.col("first") == F.col("doc_id"), F.lit(True)).alias("sends"))
    sent = sends.mapInArrow(_send(k, p), _SENT).repartitionById(p, F.col("dest"))
    counted = scratch.keep(sent.mapInArrow(_count(p), _SENT), "counted")
    active = scratch.keep(counted.repartitionById(p, F.col("dest")).mapInArrow(_gather(percent), _ACTIVE), "active")
    weight = active.groupBy("least").agg(F.count("*").alias("sets"), F.sum(F.length("tokens") / 8).alias("held"))
    split = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("held") / BLOCK_TOKENS))
    active = active.join(weight.select("least", split.alias("blocks")), "least")
    active = active.withColumn("block", F.xxhash64("least", F.pmod(F.xxhash64("id"), F.col("blocks"))))
    blocks = scratch.keep(active.groupBy("block").agg(F.collect_list(F.struct("id", "n", "tokens")).alias("members"), F.array_distinct(F.flatten(F.collect_list("prefix"))).alias("prefix")), "blocks")
    matrix = blocks.select("block", F.explode("prefix").alias("token"))
    rows = matrix.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    matrix = scratch.keep(matrix.join(rows, "token"), "matrix")
    pairs = matrix.select("token", F.col("block").alias("x")).join(matrix.select("token", F.col("block").alias("y")), "token").where("x < y").select("x", "y").distinct()
    held = blocks.select("block", "members")
    across = pairs.join(held.select(F.col("block").alias("x"), F.col("members").alias("xs")), "x").join(held.select(F.col("block").alias("y"), F.col("members").alias("ys")), "y").select("xs", "ys")
    within = held.where(F.size("members") > 1).select(F.col("members").alias("xs"), F.lit(None).cast(held.schema["members"].dataType).alias("ys"))
    links = scratch.keep(across.unionByName(within).mapInArrow(_verify(percent), "a long, b long"), "links")
    comps = scratch.keep(components(links, scratch), "components")
    sets = counted.where("kind = 0").select("doc_id", "owner", F.col("n").alias("n_shingles"))
    first = sets.where("n_shingles > 0").groupBy("owner").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    first = first.join(comps, "node", "left").where("copies > 1 or component is not null").select("owner", F.coalesce("component", "node").alias("component_id"))
    alone = sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = sets.where("n_shingles > 0").join(first, "owner", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return linked.unionByName(alone)


def keep_one_of_each(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without those that have a smaller doc_id in their component. Rows with the same doc_id count as one document."""
    gone = similar_components(docs, k, percent).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
