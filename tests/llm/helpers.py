"""Small documents with every odd case: nulls, empty and long texts, repeated rows, extra columns with clashing names."""

import random
import re

#: Names that operators might use inside are among the further columns.
CLASHES = "row", "doc", "path", "count", "bucket", "_row", "_mean", "_source", "_count", "_part", "_parts", "_url", "_key", "rep", "label", "size"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def documents(spark, texts, ids=None, source=None):
    rows = [(k if ids is None else ids[k], t, "en", source(k) if source else f"s{k % 3}", len(t) if t is not None else None, *CLASHES) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_texts(seed=1):
    rng = random.Random(seed)
    base = prose(rng, 120)
    return [base, None, "", "   \t\n ", base, base.replace(" ", "  \n"), base.upper(), "one two", "one two", "é" * 50, "x" * 30_000, prose(rng, 3000), "a\u0001b\u0000c", base + " tail"]


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", low)
