"""Grouping of spelling variants: words that one inserted, deleted or replaced code point tells apart, and their usual forms."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize
from .textvec import U64, mix

_RUN = re.compile("[a-zÀ-ÿ]+")
#: A task hands on its counts when it holds this many words, and compares this many pairs at a time.
_HELD = 200_000
_PAIRS = 1 << 16
#: A text this long is cut into its words bit by bit.
_LONG = 1 << 20


def noisy_word(run: str, before: int, every: int) -> str:
    """The run, less one of its code points where `every` divides the CRC-32 that goes on from `before` over the run."""
    h = zlib.crc32(run.encode(), before)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _word_lists(text: str) -> Iterator[list[str]]:
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    if len(low) < _LONG:
        yield _RUN.findall(low)
        return
    found = _RUN.finditer(low)
    while part := [m[0] for m in islice(found, 1 << 16)]:
        yield part


def _counts(shortest: int, every: int):
    def batch(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def run(batches):
        total: Counter = Counter()
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                before = zlib.crc32(f"{'' if i is None else i}:".encode())
                for words in _word_lists(text.as_py() or ""):
                    for w, n in Counter(words).items():
                        if len(w) >= shortest and len(w := noisy_word(w, before, every)) >= shortest:
                            total[w] += n
                if len(total) >= _HELD:
                    yield batch(total)
                    total = Counter()
        yield batch(total)

    return run


def word_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, every: int = 31) -> DataFrame:
    """(word, n): the words of at least `shortest` code points that occur at least `least` times in all texts."""
    rows = documents.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("text != ''")
    return rows.mapInArrow(_counts(shortest, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _window(m: int) -> int:
    """Code points of a word of m that a group leaves free: two, or a sixteenth of a long word."""
    return max(2, -(-m // 16))


def _sides(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all beginnings and of all endings of words of one length: [word, number of code points]."""
    out = []
    for side in (words, words[:, ::-1]):
        h = np.zeros((len(words), words.shape[1] + 1), U64)
        for j in range(words.shape[1]):
            h[:, j + 1] = mix(h[:, j] * U64(0x9E3779B97F4A7C15) + side[:, j].astype(U64) + U64(1))
        out.append(h)
    return out[0], out[1]


def _group_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, tag, word, n): the groups of a word, as the longer of two (m is its length) and as the shorter one (m is that plus one).

    Of two words that one edit tells apart, with m code points in the longer, let the edit stand in window k of it: both have
    the code points before the window in front, and those behind it at the end. So they meet in the group (m, k, those
    two parts), which leaves a window of code points free and is small for that: with two free ones of an alphabet of 90
    letters it has 8190 words at most, whatever the corpus.
    """
    for b in batches:
        words = np.array([w.encode("latin-1") for w in b.column(0).to_pylist()], object)
        n, length = b.column(1).to_numpy(), np.array([len(w) for w in words], np.int64)
        for size in np.unique(length):
            mine = np.flatnonzero(length == size)
            begins, ends = _sides(np.frombuffer(b"".join(words[mine]), np.uint8).reshape(len(mine), size))
            step = max(1, (1 << 22) // int(size))
            for m in (int(size), int(size) + 1):
                w = _window(m)
                for k in range(-(-m // w)):
                    tag = m * 64 + k
                    key = mix(begins[:, min(k * w, size)] + mix(ends[:, max(0, m - (k + 1) * w)] + U64(tag))).view(np.int64)
                    for lo in range(0, len(mine), step):
                        at = mine[lo : lo + step]
                        yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + step]), pa.array(np.full(len(at), tag), pa.int64()), pa.array(list(words[at]), pa.binary()), pa.array(n[at])], ["key", "tag", "word", "n"])


def _padded(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code-point matrices of the words: one with them flush left, one with them reversed, so that their ends are flush."""
    left = np.array(words, f"S{width}").view(np.uint8).reshape(-1, width)
    right = np.array([w[::-1] for w in words], f"S{width}").view(np.uint8).reshape(-1, width)
    return left, right


def _common(tile: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Columns that the rows of two tiles have in common at the front."""
    differ = tile != other
    return np.where(differ.any(1), differ.argmax(1), tile.shape[1])


def near_pairs(group: np.ndarray, tag: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of the words of a group, groups being runs of equal numbers, that one edit tells apart.

    Rows meet those 1, 2, ... places further on, block by block: the common prefix and the common suffix of two words reach the
    longer one's length less one only if they differ by one edit. A pair that meets in several groups counts in that of the
    window where the words first differ.
    """
    length = np.array([len(w) for w in words], np.int64)
    m, k = tag // 64, tag % 64
    free = np.maximum(2, -(-m // 16))
    left, right = _padded(words, int(length.max()))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rows = np.arange(len(words) - 1)
    for d in range(1, len(words)):
        rows = rows[rows < len(words) - d]
        rows = rows[group[rows] == group[rows + d]]
        if not len(rows):
            break
        both = rows[(length[rows] == m[rows]) | (length[rows + d] == m[rows])]
        step = max(1, (_PAIRS << 4) // left.shape[1])
        for lo in range(0, len(both), step):
            i = both[lo : lo + step]
            j = i + d
            front = _common(left[i], left[j])
            near = (front < m[i]) & (front // free[i] == k[i])
            i, j, front = i[near], j[near], front[near]
            near = front + _common(right[i], right[j]) >= m[i] - 1
            found.append((i[near], j[near]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, best_n, best): of each word, its near words within the groups at hand; rows come sorted by key and tag."""

    def compare(t: pa.Table):
        key, tag, n, words = t["key"].to_numpy(), t["tag"].to_numpy(), t["n"].to_numpy(), t["word"].to_pylist()
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])
        group = np.cumsum(first)
        met = np.bincount(group)[group] > 1
        # Words of like length share a matrix, so that a long one doesn't widen the others'.
        width = np.ceil(np.log2(tag // 64)).astype(np.int64)
        for c in np.unique(width[met]):
            at = np.flatnonzero(met & (width == c))
            i, j = near_pairs(group[at], tag[at], [words[x] for x in at])
            if not len(i):
                continue
            of, to = at[np.concatenate([i, j])], at[np.concatenate([j, i])]
            spelt = np.array([words[x] for x in to], object)
            order = np.lexsort((np.argsort(np.argsort(spelt, kind="stable"), kind="stable"), -n[to], of))
            of, to = of[order], to[order]
            start = np.flatnonzero(np.diff(of, prepend=-1))
            count = np.diff(np.append(start, len(of)))
            text = lambda rows: pa.array([words[x].decode("latin-1") for x in rows], pa.string())
            yield pa.RecordBatch.from_arrays([text(of[start]), pa.array(count), pa.array(n[to[start]]), text(to[start])], ["word", "n_near", "best_n", "best"])

    kept: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if kept is None else pa.concat_tables([kept, t]).combine_chunks()
        key = t["key"].to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on in the next batch
        if cut:
            yield from compare(t.slice(0, cut))
        kept = t.slice(cut)
    if kept is not None and len(kept):
        yield from compare(kept)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) of (word, n): the number of near words, and the usual form where there is one."""
    groups = words.select("word", "n").mapInArrow(_group_keys, "key long, tag long, word binary, n long")
    near = groups.repartition("key").sortWithinPartitions("key", "tag").mapInArrow(_neighbours, "word string, n_near long, best_n long, best string")
    best = F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word"))
    every = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<minus:bigint,word:string>").alias("best")).unionByName(near.select("word", F.lit(None).cast("long").alias("n"), "n_near", best.alias("best")))
    of = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return of.withColumn("best", F.when(-F.col("best.minus") >= 10 * F.col("n"), F.col("best"))).select("word", "n", "n_near", F.col("best.word").alias("form"), (-F.col("best.minus")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: where following forms ends. Each round doubles the steps taken.

    A form occurs ten times as often as its word, so that no path is longer than the number of digits of the largest count.
    """
    hops = materialize(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "hops")
    while True:
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = hops.join(further, "root", "left")
        if joined.filter("next IS NOT NULL").isEmpty():
            return hops
        ahead = materialize(joined.select("word", F.coalesce("next", "root").alias("root")), "hops")
        discard(hops)
        hops = ahead


def spelling_variants(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, every: int = 31) -> DataFrame:
    """(word, root, n, n_near, form, form_n) of the words of all texts.

    Words are maximal runs of `[A-Za-zÀ-ÿ]`, A-Z in lower case, of which one in `every` loses a code point by a hash of id and
    word; words of fewer than `shortest` code points or with fewer than `least` occurrences are left out. Null and empty texts have none, a
    null id counts as an empty one; repeated rows count each; of near words that are as frequent, the first in
    code-point order is the form. An empty table gives no rows; further columns, whatever their names, aren't read. Texts
    are read whole whatever their length; words over 32 code points share wider groups, with the same result.
    """
    words = materialize(word_counts(documents, id_col, text_col, shortest, least, every), "words")
    table = materialize(neighbours(words), "near-words")
    discard(words)
    return table.join(roots(table), "word", "left").select("word", F.coalesce("root", "word").alias("root"), "n", "n_near", "form", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """The words of all documents with their near words, forms and roots."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _crc_steps() -> str:
    """CRC-32 (polynomial 0xEDB88320) of four bits, for a reduction over half bytes, as a SQL list."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return "[" + ", ".join(map(str, table)) + "]::BIGINT[]"


ORACLE_OP11 = rf"""
WITH RECURSIVE run AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents)),
counted AS MATERIALIZED (SELECT doc_id, r, count(*) AS n, hex(encode(doc_id || ':' || r)) AS x FROM run WHERE length(r) >= 7 GROUP BY ALL),
half AS (SELECT r, n, list_prepend(4294967295, list_transform(range(0, length(x)), lambda i: CAST(instr('123456789ABCDEF', substr(x, xor(i, 1) + 1, 1)) AS BIGINT))) AS halves FROM counted),
hashed AS (SELECT r, n, xor(list_reduce(halves, lambda c, b: xor(({_crc_steps()})[xor(c, b) % 16 + 1], c >> 4)), 4294967295) AS h FROM half),
word AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM word)),
shorter AS (SELECT DISTINCT cut.word AS a, word.word AS b FROM cut JOIN word ON v = word.word),
near AS (
  SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter
  UNION ALL SELECT x.word, y.word FROM cut x JOIN cut y ON x.i = y.i AND x.v = y.v AND x.word <> y.word),
ranked AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place FROM near JOIN word ON word = b),
table_ AS MATERIALIZED (
  SELECT word, word.n, coalesce(n_near, 0) AS n_near, CASE WHEN ranked.n >= 10 * word.n THEN b END AS form, CASE WHEN ranked.n >= 10 * word.n THEN ranked.n END AS form_n
  FROM word LEFT JOIN ranked ON a = word AND place = 1),
walk AS (SELECT word, word AS here, 0 AS step FROM table_ UNION ALL SELECT walk.word, form, step + 1 FROM walk JOIN table_ ON table_.word = here WHERE form IS NOT NULL)
SELECT word, root, n, n_near, form, form_n FROM table_ JOIN (SELECT word, arg_max(here, step) AS root FROM walk GROUP BY word) USING (word)
"""
