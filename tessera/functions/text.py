"""Column functions on text and tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The pre-tokenizer's pattern, and the tokens that mark documents and turns.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = "<|endoftext|>"
SPECIALS = ("<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def universal_newlines(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), "\\r\\n?", "\n")


def pretokens(c: str | Column) -> Column:
    """The pre-tokens of a text, in order; (?U) gives \\s its Unicode meaning."""
    return F.regexp_extract_all(_col(c), F.lit("(?U)" + PATTERN), F.lit(0))


def byte_sequence(c: str | Column) -> Column:
    """'<68><69>' for 'hi': a merge is then one replace()."""
    return F.regexp_replace(F.hex(F.encode(_col(c), "UTF-8")), "(..)", "<$1>")


def _bytes_of(text: pa.Array) -> pa.Array:
    if not len(text):
        return pa.array([], pa.list_(pa.int32()))
    _, offsets, data = text.buffers()
    offs = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text) + 1]
    own = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data else np.zeros(0, np.uint8)
    return pa.ListArray.from_arrays(pa.array(offs - offs[0]), pa.array(own.astype(np.int32)), mask=text.is_null() if text.null_count else None)


def byte_ids(c: str | Column) -> Column:
    """The numbers of a text's UTF-8 bytes: the text's own buffer, widened."""
    # called non-deterministic so that a filter on its size does not run it again
    return F.arrow_udf(_bytes_of, T.ArrayType(T.IntegerType())).asNondeterministic()(_col(c))


def _single_bytes(raw: pa.Array) -> pa.Array:
    if not len(raw):
        return pa.array([], pa.list_(pa.binary()))
    _, offsets, data = raw.buffers()
    offs = np.frombuffer(offsets, np.int32)[raw.offset : raw.offset + len(raw) + 1]
    own = pa.py_buffer(data[offs[0] : offs[-1]] if data else b"")
    each = pa.Array.from_buffers(pa.binary(), int(offs[-1] - offs[0]), [None, pa.py_buffer(np.arange(offs[-1] - offs[0] + 1, dtype=np.int32)), own])
    return pa.ListArray.from_arrays(pa.array(offs - offs[0]), each, mask=raw.is_null() if raw.null_count else None)


def byte_tokens_of(c: str | Column) -> Column:
    """Each of the bytes of a binary value as a binary value of its own."""
    return F.arrow_udf(_single_bytes, T.ArrayType(T.BinaryType())).asNondeterministic()(_col(c))


def _units_of(text: pa.Array) -> pa.Array:
    units = [None if t is None else t.decode("utf-8", "replace").encode("utf-16-le") for t in text.cast(pa.binary()).to_pylist()]
    offs = np.concatenate([[0], np.cumsum([len(u or b"") // 2 for u in units])]).astype(np.int32)
    own = np.frombuffer(b"".join(u or b"" for u in units), "<u2").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(own), mask=pa.array([u is None for u in units]) if text.null_count else None)


def utf16_ids(c: str | Column) -> Column:
    """The numbers of a text's UTF-16 units."""
    return F.arrow_udf(_units_of, T.ArrayType(T.IntegerType())).asNondeterministic()(_col(c))


def first_code_point(units: str | Column) -> Column:
    """The code point that a list of UTF-16 units begins with, a pair of surrogates being one; -1 for an empty list."""
    a, b = F.get(_col(units), F.lit(0)).cast("long"), F.get(_col(units), F.lit(1)).cast("long")
    pair = a.between(0xD800, 0xDBFF) & F.coalesce(b.between(0xDC00, 0xDFFF), F.lit(False))
    return F.when(pair, (a - 0xD800) * 1024 + (b - 0xDC00) + 0x10000).when(F.size(_col(units)) == 0, F.lit(-1).cast("long")).otherwise(a)


def sequence_tokens(c: str | Column) -> Column:
    """The hex tokens of a byte sequence."""
    c = _col(c)
    return F.split(F.substring(c, F.lit(2), F.length(c) - 2), "><")


def merged(c: str | Column, a: str, b: str) -> Column:
    return F.replace(_col(c), F.lit(f"<{a}><{b}>"), F.lit(f"<{a}{b}>"))


def strip(c: str | Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def split_specials(c: str | Column, specials=SPECIALS, keep: bool = False) -> Column:
    """Pieces between specials (longest special first); with keep, the specials are pieces too."""
    quoted = "|".join("\\Q" + s + "\\E" for s in sorted(specials, key=lambda s: (-len(s), specials.index(s))))
    if keep:
        return F.regexp_extract_all(_col(c), F.lit(f"(?s){quoted}|.+?(?={quoted}|\\z)"), F.lit(0))
    return F.split(_col(c), quoted)


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the MD5 of a key."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def epoch_seconds(c: str | Column) -> Column:
    """Whole seconds from 1970 to a timestamp without a zone, whatever the session's zone."""
    c = _col(c)
    return F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def log_sigmoid(x: Column) -> Column:
    """log(1 / (1 + exp(-x))) without overflow."""
    return F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def cosine_schedule(t: Column, top: float, low: float, warm: int, end: int) -> Column:
    """Linear warm-up to `top`, a cosine down to `low` between `warm` and `end`, then `low`."""
    part = (t - warm) / F.lit(float(end - warm))
    return F.when(t < warm, t / F.lit(float(warm)) * top).when(t <= end, low + 0.5 * (1 + F.cos(part * F.lit(3.141592653589793))) * (top - low)).otherwise(F.lit(low))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def stop_place(text: Column, stops: Column) -> Column:
    """The first place (from 0) of any non-empty stop string; null if none occurs."""
    return F.array_min(F.filter(F.transform(F.filter(stops, lambda s: s != ""), lambda s: F.instr(text, s) - 1), lambda i: i >= 0))
