"""Registration, tables, and SQL that several oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with DuckDB SQL for the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df over all cores, if its files came in fewer partitions than there are; with `rows`, about so many rows in a partition at most."""
    n = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        return df.repartition(max(n, -(-df.count() // rows)))
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


_WS = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def sql_pretokens(text: str) -> str:
    """DuckDB SQL for the pre-tokens of a text: RE2 has no look-ahead, so the last blank of a run is marked first."""
    pattern = r"''(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^" + _WS + r"\p{L}\p{N}\x{E000}]+|[" + _WS + "]+"
    return f"regexp_extract_all(regexp_replace({text}, '([{_WS}])([^{_WS}])', chr(57344) || '\\1\\2', 'g'), '{pattern}')"


def sql_words(source: str = "SELECT text FROM documents") -> str:
    """DuckDB CTE: pre-token types with counts and byte sequences."""
    return f"""pre AS (SELECT unnest({sql_pretokens("text")}) AS word FROM ({source})),
    words AS (SELECT word, regexp_replace(hex(encode(word)), '(..)', '<\\1>', 'g') AS seq, count(*)::BIGINT AS cnt FROM pre GROUP BY word)"""


MERGES = 10


def sql_bpe(source: str = "SELECT text FROM documents", merges: int = MERGES) -> str:
    """DuckDB CTEs (after WITH RECURSIVE): steps of BPE training; `merged` has rank, a, b, cnt and `final` each word's last sequence."""
    return f"""{sql_words(source)},
    steps AS (
      SELECT 0 AS k, word, seq, cnt, ''::VARCHAR AS a, ''::VARCHAR AS b, 0::BIGINT AS c FROM words
      UNION ALL
      SELECT k + 1, s.word, replace(s.seq, '<' || p.a || '><' || p.b || '>', '<' || p.a || p.b || '>'), s.cnt, p.a, p.b, p.c
      FROM steps s, (
        SELECT a, b, sum(cnt)::BIGINT AS c FROM (
          SELECT cnt, unnest(t[:-2]) AS a, unnest(t[2:]) AS b FROM (SELECT cnt, string_split(seq[2:-2], '><') AS t FROM steps) WHERE len(t) > 1)
        WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, b ORDER BY c DESC, a DESC, b DESC LIMIT 1) p
      WHERE k < {merges}),
    merged AS (SELECT DISTINCT k - 1 AS rank, a, b, c FROM steps WHERE k > 0),
    final AS (SELECT word, seq, cnt FROM steps WHERE k = (SELECT max(k) FROM steps))"""


SPECIAL_ROWS = "(VALUES (256, '<|endoftext|>'), (257, '<|user|>'), (258, '<|assistant|>'), (259, '<|system|>')) s(id, txt)"


def sql_vocab() -> str:
    """DuckDB CTE after sql_bpe: vocab(id, tok)."""
    return f"vocab AS (SELECT i::INT AS id, upper(printf('%02x', i)) AS tok FROM range(256) r(i) UNION ALL SELECT id, hex(encode(txt)) FROM {SPECIAL_ROWS} UNION ALL SELECT (260 + rank)::INT, a || b FROM merged)"
