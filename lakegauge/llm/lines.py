"""Quality rules over words and lines, and the frequency of lines across the documents of a host.

Everything is DataFrame expressions; nothing runs in Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lakegauge.llm.common import WHITE

_GAP, _WORD, _SYMBOL = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words in repeated windows
MIN_DOCS, MAX_SHARE = 20, 0.005  # a line goes when more documents of its host hold it than both say
MAX_LOST = 50  # per cent of words that removed lines may take


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once; a plain reference would be computed again for every array element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    inner = F.btrim(text, F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _GAP))


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more.

    Windows are sorted as 64-bit words that hold a hash above and the place below, with as few bits for the place as
    the text needs; equal neighbours are repeats, and their places in order tell how many words they cover.
    """
    def covered(h: Column, n: Column) -> Column:
        bits = F.ceil(F.log2(n.cast("double") + 1)).cast("int")
        return let(F.expr("cast(1 as bigint)") * F.pow(F.lit(2.0), bits).cast("bigint") - 1, lambda low: let(
            F.array_sort(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
                F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("bigint")))),
            lambda p: places(p, low)))

    def places(p: Column, low: Column) -> Column:
        high = F.bitwise_not(low)

        def same(x: Column, other: Column) -> Column:
            return F.coalesce(x.bitwiseXOR(other).bitwiseAND(high) == 0, F.lit(False))

        again = F.filter(p, lambda x, i: same(x, F.get(p, i - 1)) | same(x, F.get(p, i + 1)))
        start = F.struct(F.lit(-3).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(F.array_sort(F.transform(again, lambda x: x.bitwiseAND(low))), start, lambda a, x: F.struct(
            x.alias("at"), (a["n"] + F.least(F.lit(3).cast("bigint"), x - a["at"])).alias("n")), lambda a: a["n"])

    return let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: F.when(F.size(h) < 4, F.lit(0).cast("bigint"))
                .otherwise(covered(h, F.size(h))))


def _key(id: str, text: str, host: str) -> list[Column]:
    """Two words that tell documents apart; rows alike in id, text and host are one."""
    cells = [c for n in (id, text, host) for c in (F.col(n).isNull(), F.col(n))]
    return [F.xxhash64(*cells).alias("k1"), F.xxhash64(F.lit(1), *reversed(cells)).alias("k2")]


def line_frequency(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS,
                   max_share: float = MAX_SHARE) -> DataFrame:
    """(k1, k2, lost): how many words of a document lie in lines that too many documents of its host hold.

    Lines are compared by a 64-bit hash of their lower-case words. A document counts once for a line however often it
    repeats it; rows count as documents. Counts combine before the shuffle, so a line that every document holds is
    one row per task.
    """
    normal = F.lower(F.regexp_replace(F.btrim(F.col("line"), F.lit(WHITE)), _GAP, " "))
    rows = docs.select(*_key(id, text, host), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    each = rows.select("k1", "k2", "host", F.explode(lines_of(F.col("text"))).alias("line")) \
        .select("k1", "k2", "host", F.xxhash64(normal).alias("hash"), F.regexp_count("line", F.lit(_WORD)).alias("words"))
    lines = rows.select("host", F.explode(F.array_distinct(F.transform(lines_of(F.col("text")), lambda x: F.xxhash64(
        F.lower(F.regexp_replace(F.btrim(x, F.lit(WHITE)), _GAP, " ")))))).alias("hash"))
    held = lines.groupBy("host", "hash").agg(F.count("*").alias("holders")).where(F.col("holders") > min_docs)
    hosts = docs.groupBy(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")).agg(F.count("*").alias("docs"))
    heavy = held.join(hosts, "host").where(F.col("holders") > F.col("docs") * max_share).select("host", "hash")
    per_line = each.join(heavy, ["host", "hash"]).groupBy("k1", "k2", "hash").agg(F.max("words").alias("words"), F.count("*").alias("times"))
    # a line that stands several times in one document counts each time; a repeated row does not
    copies = rows.groupBy("k1", "k2").agg(F.count("*").alias("copies")).where("copies > 1")
    whole = per_line.join(copies, ["k1", "k2"], "left")
    return whole.groupBy("k1", "k2").agg(F.sum(F.expr("words * times div coalesce(copies, 1)")).alias("lost"))


def judged(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS,
           max_share: float = MAX_SHARE) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost, kept.

    base_failed: fewer than 50 words, or more than half of them in repeated windows. Not kept are these and what the
    removal of frequent lines depletes: fewer than 50 words left, or more than half of them gone. Null texts are empty;
    a null host is the host ''. Texts are read whole.
    """
    docs = docs.select(F.col(f"`{id}`").alias(id), F.col(f"`{text}`").cast("string").alias(text), F.col(f"`{host}`").alias(host))
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.size("words").cast("bigint")
    measured = docs.select(F.col(id), *_key(id, text, host), words_of(t).alias("words"), t.alias("text"), lines_of(t).alias("lines"))
    measured = measured.select(
        id, "k1", "k2", n.alias("n_words"), F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(_SYMBOL)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    out = measured.withColumn("base_failed", failed).join(line_frequency(docs, id, text, host, min_docs, max_share), ["k1", "k2"], "left") \
        .withColumn("lost", F.coalesce("lost", F.lit(0)).cast("bigint"))
    depleted = (F.col("n_words") - F.col("lost") < MIN_WORDS) | (F.col("lost") * 100 > F.col("n_words") * MAX_LOST)
    return out.select(id, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost",
                      (~F.col("base_failed") & ~depleted).alias("kept"))


# the same in DuckDB, over the table documents
SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT rn, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
win AS (SELECT rn, words, unnest(range(0, len(words) - 2)) AS i FROM w),
key AS (SELECT rn, i, [words[i + 1], words[i + 2], words[i + 3]] AS k FROM win),
rep AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, k) AS c FROM key) WHERE c > 1),
cov AS (SELECT rn, count(DISTINCT p) AS n_repeat_words FROM (SELECT rn, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rn),
ln AS (SELECT rn, host, line FROM (SELECT rn, host, unnest(string_split(text, chr(10))) AS line FROM docs)
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rn, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln GROUP BY rn),
nl AS (SELECT rn, host, lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')) AS line,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM ln),
size AS (SELECT host, count(*) AS docs FROM docs GROUP BY host),
heavy AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT rn) AS holders FROM nl GROUP BY host, line) JOIN size USING (host)
          WHERE holders > 20 AND holders > docs * 0.005),
lost AS (SELECT rn, sum(words) AS lost FROM nl JOIN heavy USING (host, line) GROUP BY rn),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost
      FROM w LEFT JOIN cov USING (rn) LEFT JOIN dup USING (rn) LEFT JOIN lost USING (rn))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost,
  NOT base_failed AND n_words - lost >= 50 AND lost * 100 <= n_words * 50 AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
"""
