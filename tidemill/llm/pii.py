"""Personal data by patterns and by bootstrapped contexts. DataFrame functions only.

Seed entities are found by their form. The words around them make lexical patterns; a bipartite graph of patterns and
the identifier-like words that they surround is scored in rounds, from the seeds to patterns and from patterns to unseen
words, and words that confident patterns point at are reported as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

#: The base patterns, written so that Java's engine neither backtracks over long runs nor recurses; each finds the same
#: leftmost matches as the plain form beside it.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"  # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"  # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: A chain of digits with at most one sign between two, whole, and of 13 to 19 digits: others can't be cards.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"  # [0-9]([\x20-]?[0-9])+
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A word that may be an identifier: 6 letters, digits, _ or - or more, four digits among them at least.
CANDIDATE = r"(?<![0-9A-Za-z_-])(?=(?:[A-Za-z_-]*+[0-9]){4})[0-9A-Za-z_-]{6,}+"
#: Words of contexts are runs of letters, marks, digits and _; all else only parts them.
_IN, _OUT = r"[\p{L}\p{M}\p{N}_]", r"[^\p{L}\p{M}\p{N}_]"
BEFORE2 = rf"(?<!{_IN})({_IN}++){_OUT}++{_IN}++{_OUT}*+\z"
BEFORE1 = rf"(?<!{_IN})({_IN}++){_OUT}*+\z"
AFTER1 = rf"\A{_OUT}*+({_IN}++)"
SPAN = "struct<start:bigint,end:bigint,found:string,before2:string,before1:string,after1:string>"

KINDS = ("email", "ip", "card", "phone")
DISCOVERED = "id"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body, or a function within it, reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column) -> Column:
    """Running sums of an array, in blocks of about the root of its size: n ** 1.5 steps, as each append copies."""

    def sums(part: Column) -> Column:
        zero = F.array(F.lit(0).cast("long"))
        return F.slice(F.aggregate(part, zero, lambda s, v: F.array_append(s, F.element_at(s, -1) + v)), F.lit(2), F.size(part))

    def merged(blocks: Column) -> Column:
        within, totals = F.transform(blocks, sums), F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, v: s + v))
        both = F.struct(within.alias("within"), sums(totals).alias("to"))
        return _let(both, lambda b: F.flatten(F.transform(b["within"], lambda w, i: F.transform(w, lambda v: v + F.coalesce(F.get(b["to"], i - 1), F.lit(0))))))

    size = F.ceil(F.sqrt(F.size(values))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda b: F.slice(values, b * size + 1, size))
    return _let(blocks, merged)


def spans(text: Column, pattern: str) -> Column:
    """array<SPAN> of the leftmost non-overlapping matches, in code points, with the words around each.

    before2, before1 and after1 are the two words before a match and the one after it, in the whole text: they may lie in
    neighbouring matches or beyond them. Only a word that runs into a third match is cut where that begins. '' if none.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def build(p: Column) -> Column:
        part = lambda name, i: F.coalesce(F.get(p[name], i), F.lit(""))
        lengths = F.transform(p["found"], lambda m, i: (F.length(F.get(p["between"], i)) + F.length(m)).cast("long"))

        def one(end: Column, i: Column) -> Column:
            match = F.get(p["found"], i)
            near = F.struct(
                F.concat(part("between", i - 2), part("found", i - 2), part("between", i - 1), part("found", i - 1), part("between", i)).alias("left"),
                F.concat(part("between", i + 1), part("found", i + 1), part("between", i + 2)).alias("right"),
            )
            words = lambda c: F.struct(
                (end - F.length(match)).alias("start"), end.alias("end"), match.alias("found"),
                F.regexp_extract(c["left"], BEFORE2, 1).alias("before2"), F.regexp_extract(c["left"], BEFORE1, 1).alias("before1"), F.regexp_extract(c["right"], AFTER1, 1).alias("after1"),
            )
            return _let(near, words)

        ends = _let(lengths, _running)
        return F.when(F.size(p["found"]) > 0, F.transform(ends, one)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return _let(F.struct(found.alias("found"), between.alias("between")), build)


def luhn(digits: Column) -> Column:
    """Whether a string of 13 to 19 digits passes the Luhn check; null or false for others."""
    n = F.length(digits)
    doubled = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            (F.substring(digits, i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substring(digits, i, F.lit(1)).cast("int") / 5).cast("int")
        ),
    )
    return n.between(13, 19) & (F.aggregate(F.when(n.between(13, 19), doubled).otherwise(F.array(F.lit(1))), F.lit(0), lambda a, x: a + x) % 10 == 0)


def _small(part: Column) -> Column:
    """Whether a run of digits is at most 255, leading zeros and any length allowed."""
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(F.left(bare, F.lit(3)).try_cast("int"), F.lit(0)) <= 255)


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays as spans() gives them, of the entities whose form is valid."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    none = F.array().cast(f"array<{SPAN}>")
    some = lambda sign, c: F.when(sign, c).otherwise(none)
    numeric = text.rlike("[0-9]")
    return {
        "email": some(text.contains("@"), spans(text, EMAIL)),
        "ip": some(numeric & text.rlike(r"[0-9]\.[0-9]"), F.filter(spans(text, IP), lambda s: F.forall(F.split(s["found"], r"\."), _small))),
        "card": some(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), F.filter(spans(text, CARD), lambda s: luhn(digits(s["found"])))),
        "phone": some(text.contains("+"), F.filter(spans(text, PHONE), lambda s: F.length(digits(s["found"])).between(9, 15))),
    }


def _word(c: Column) -> Column:
    """Lower case; words with digits become 0, so that numbers and identifiers in a context stand for one another."""
    return F.when(c.rlike("[0-9]"), F.lit("0")).otherwise(F.lower(c))


def _patterns(span: Column) -> Column:
    """Lexical patterns of a span's context: the two words before, and a word on both sides."""
    before2, before1, after1 = (span[k] for k in ("before2", "before1", "after1"))
    two = F.when((before2 != "") & (before1 != ""), F.concat_ws(" ", F.lit("L"), _word(before2), _word(before1)))
    around = F.when((before1 != "") & (after1 != ""), F.concat_ws(" ", F.lit("B"), _word(before1), F.lit("_"), _word(after1)))
    return F.filter(F.array(two, around), lambda p: p.isNotNull())


def score_graph(edges: DataFrame, rounds: int = 3, least_seeds: int = 3, damping: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(patterns with confidence, instances with score) from (pattern, instance, n, seed) edges.

    A pattern's confidence is the share of its distinct instances' scores, with `damping` instances of score 0 added,
    and 0 unless least_seeds different seeds stand in it. An instance scores 1 if it is a seed, else the mean confidence
    of its patterns weighed by how often they surround it. Both are sums over edges, which combine before the shuffle.
    """
    instances = materialize(edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score")), "instances")
    patterns = None
    for _ in range(rounds):
        scored = edges.join(instances, "instance")
        conf = F.when(F.sum(F.col("seed").cast("int")) >= least_seeds, F.sum("score") / (F.count("*") + damping)).otherwise(0.0)
        patterns = materialize(scored.groupBy("pattern").agg(conf.alias("confidence")), "patterns")
        mean = F.sum(F.col("confidence") * F.col("n")) / F.sum("n")
        instances = materialize(edges.join(patterns, "pattern").groupBy("instance").agg(F.when(F.max("seed"), 1.0).otherwise(mean).alias("score")), "instances")
    return patterns, instances


def find_pii(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, confidence: float = 0.5, score: float = 0.4) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, n_id, base_sha256, spans.

    Base spans are those of the four patterns whose form is valid. Further spans, of kind id, are identifier-like words
    beside no base span in which a pattern of at least the given confidence meets an instance of at least the given score.
    spans holds kind:start:end of all, by kind (email, ip, card, phone, id) and start, joined by commas; base_sha256 is the
    digest of the base ones alone. Null texts are empty; documents without any have empty spans. Each row stands for
    itself, whether it repeats or not, and columns besides the id and the text are not read. An empty table gives an empty
    result. Whole texts are searched; long runs of one character are passed in linear time.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    none = F.array().cast(f"array<{SPAN}>")
    numeric = F.col("text").rlike("[0-9][^0-9]*+[0-9][^0-9]*+[0-9][^0-9]*+[0-9]")
    words = F.when(numeric, spans(F.col("text"), CANDIDATE)).otherwise(none)
    found = rows.select("_row", "doc_id", *(c.alias(k) for k, c in base_spans(F.col("text")).items()), words.alias("words"))
    found = materialize(found, "entities")

    known = F.concat(*KINDS)
    entity = found.filter(F.size(known) > 0).select("_row", F.explode(known).alias("w"))
    entity = entity.select("_row", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.lower("w.found").alias("instance"), F.lit(True).alias("seed"), _patterns(F.col("w")).alias("patterns"))
    word = found.filter(F.size("words") > 0).select("_row", known.alias("known"), F.explode("words").alias("w"))
    beside = ~F.exists("known", lambda s: (s["start"] < F.col("w.end")) & (F.col("w.start") < s["end"]))
    word = word.filter(beside).select("_row", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.lower("w.found").alias("instance"), F.lit(False).alias("seed"), _patterns(F.col("w")).alias("patterns"))
    word = materialize(entity.unionByName(word), "words")
    edges = word.select(F.explode("patterns").alias("pattern"), "instance", "seed").groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    edges = materialize(edges, "graph")
    patterns, instances = score_graph(edges, rounds)
    unseen = word.filter(~F.col("seed")).select("_row", "start", "end", "instance", F.explode("patterns").alias("pattern"))
    hits = unseen.join(patterns.filter(F.col("confidence") >= confidence).select("pattern"), "pattern").join(instances.filter(F.col("score") >= score).select("instance"), "instance")
    more = hits.select("_row", F.struct("start", "end").alias("s")).distinct().groupBy("_row").agg(F.array_sort(F.collect_list("s")).alias(DISCOVERED))

    said = lambda k: F.transform(F.col(k), lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string")))
    place = lambda k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k)
    joined = found.select("_row", "doc_id", *(place(k) for k in KINDS)).join(more, "_row", "left").withColumn(DISCOVERED, F.coalesce(F.col(DISCOVERED), F.array().cast("array<struct<start:bigint,end:bigint>>")))
    base = F.concat(*(said(k) for k in KINDS))
    return joined.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in (*KINDS, DISCOVERED)),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, said(DISCOVERED)), ",").alias("spans"),
    )


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
