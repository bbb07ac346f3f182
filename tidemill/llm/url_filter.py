"""URL filtering by pattern rules that are indexed by their rarest literal token. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with the rule's; the longest wins.
HOST_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: (pattern, verdict): regular expressions over the lower-case url. The literal tokens are the words of a pattern
#: outside its character classes, groups and escapes, so each of them stands in every url that it matches.
PATTERN_RULES = (
    (r"://([^/?#]*[.-])?cheap-pills\.", "block"),
    (r"://([^/?#]*[.-])?free-bets\.", "block"),
    (r"://([^/?#]*[.-])?adult-x\.", "block"),
    (r"://([^/?#]*[.-])?spam-farm\.", "block"),
    (r"://([^/?#]*\.)?casino[0-9]*\.", "block"),
    (r"[?&]utm_source=spam(&|#|$)", "block"),
    (r"/wp-login\.php([?#]|$)", "block"),
    (r"/phishing/", "block"),
    (r"/xmlrpc\.php([?#]|$)", "block"),
    (r"/phpmyadmin/", "block"),
    (r"/\.git/", "block"),
    (r"/\.env([?#]|$)", "block"),
    (r"/popunder/", "block"),
    (r"/doorway/[0-9]+\.html", "block"),
    (r"[?&]replytocom=[0-9]", "block"),
    (r"[?&]affiliate_id=[0-9]", "block"),
)
#: Words that block where they end a host's label; each gives three rules, of which the word is a literal token.
BLOCKED_WORDS = "porn", "xxx", "sexcam", "camgirls", "escorts", "hentai", "viagra", "cialis", "levitra", "poker", "slots", "betting", "jackpot", "roulette", "payday", "warez", "torrent", "keygen", "crackz", "nulled", "serialz", "malware", "botnet", "linkfarm", "clickbait", "adserver", "popads"
PATTERN_RULES += tuple((f"://{before}{word}\\.", "block") for word in BLOCKED_WORDS for before in ("", r"[^/?#]*\.", "[^/?#]*-"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def tokens(c: Column) -> Column:
    """The distinct runs of a-z and 0-9 of a lower-case string."""
    return F.array_distinct(F.filter(F.split(c, "[^a-z0-9]+"), lambda t: t != ""))


def literal_tokens(pattern: Column) -> Column:
    """The tokens that every match of the pattern contains as whole tokens of the url.

    \\u0001 stands for what may be any character or none, \\u0002 for a literal one that is no letter or digit. A literal
    counts where it touches no \\u0001; the pattern's ends are such, as more of the url may follow. Alternatives outside
    groups, and brackets nested over four deep, leave no tokens; such a rule runs on every url.
    """
    bare = F.concat(F.lit("\u0001"), pattern, F.lit("\u0001"))
    for found, stands in ((r"\\\\", "\u0002"), (r"\\[A-Za-z0-9]", "\u0001"), (r"\\[^A-Za-z0-9]", "\u0002"), (r"\[\^?\]?[^\]]*\]", "\u0001")):
        bare = F.regexp_replace(bare, found, stands)
    for _ in range(4):  # groups, from the inner ones
        bare = F.regexp_replace(bare, r"\([^()]*\)", "\u0001")
    plain = ~bare.rlike(r"[()\[\]|]")
    bare = F.regexp_replace(bare, r"[^?*+{](?:[?*+]|\{[^}]*\})+", "\u0001")
    bare = F.regexp_replace(bare, r"\.", "\u0001")
    tokens = F.filter(F.split(bare, r"[^a-z0-9\u0001]+"), lambda t: (t != "") & ~t.contains("\u0001"))
    return F.when(plain, F.array_distinct(tokens)).otherwise(F.array().cast("array<string>"))


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds _host and _path; both are empty where the url is null or has no '://'."""
    url = F.col(url_col).cast("string")
    rest = F.when(url.contains("://"), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("_host", _ascii_lower(host)).withColumn("_path", path)


def rule_table(spark: SparkSession, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """(rule_id, kind, rule, host, path, pattern, verdict, literals) of all rules.

    A pattern rule's literals may be empty, then it is tried on every url. Of a host rule they are the labels of
    its host that consist of letters and digits.
    """
    rows = [("host", h + p, h, p, None, v) for h, p, v in host_rules] + [("pattern", r, None, None, r, v) for r, v in pattern_rules]
    if not rows:
        rows = [("none", "", None, None, None, "allow")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "rule_id int, kind string, rule string, host string, path string, pattern string, verdict string")
    host = F.filter(F.split("host", r"\."), lambda t: t.rlike("^[a-z0-9]+$"))
    return df.withColumn("literals", F.when(F.col("kind") == "host", host).otherwise(F.coalesce(literal_tokens(F.col("pattern")), F.array())))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", most_rules: int = 20_000) -> DataFrame:
    """A verdict for every row of pages: page_id, host, path, rule, verdict, and pattern (the method's rule that fitted).

    The longest host rule that fits decides. Else the pattern rules do: one that blocks before one that allows,
    allow where none fits. Rules are looked up by their rarest literal token, counted over all urls; a url's tokens
    fetch their candidates and only those run their regular expression. Null and empty urls have no host, no path
    and no candidates but the rules without a literal; they are allowed. Repeated rows are each judged. Only the id
    and the url are read. Each distinct url is matched once. rules: at most most_rules rows (an error otherwise),
    since the index is broadcast.
    """
    if (n := rules.count()) > most_rules:
        raise ValueError(f"{n} rules; the index is broadcast and made for {most_rules} at most")
    rows = with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_url")), "_url")
    urls = rows.select("_url").filter("_url is not null").distinct()
    seen = urls.select("_url", F.explode(tokens(_ascii_lower(F.col("_url")))).alias("_token"))
    literals = rules.select("rule_id", F.explode("literals").alias("_token"))
    counts = seen.join(F.broadcast(literals.select("_token").distinct()), "_token").groupBy("_token").agg(F.count("*").alias("_n"))
    rarest = (
        literals.join(F.broadcast(counts), "_token", "left")
        .groupBy("rule_id")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_token").alias("token")))["token"].alias("_key"))
    )
    index = rules.join(rarest, "rule_id", "left").drop("literals").withColumn("_key", F.coalesce("_key", F.lit("")))
    keyed = urls.select("_url", F.explode(F.concat(tokens(_ascii_lower(F.col("_url"))), F.array(F.lit("")))).alias("_key"))
    candidates = with_parts(keyed.join(F.broadcast(index), "_key"), "_url")
    dotted = F.concat(F.lit("."), F.col("_host"))
    fits = F.when(F.col("kind") == "host", F.endswith(dotted, F.concat(F.lit("."), F.col("host"))) & F.startswith(F.col("_path"), F.col("path")) & (F.col("_host") != "")).when(
        F.col("kind") == "pattern", F.regexp_like(_ascii_lower(F.col("_url")), F.col("pattern"))
    )
    hits = candidates.filter(fits).groupBy("_url").agg(
        F.max(F.when(F.col("kind") == "host", F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("verdict")))).alias("_hit"),
        F.max(F.when(F.col("kind") == "pattern", F.struct((F.col("verdict") == "block").alias("b"), F.col("pattern"), F.col("verdict")))).alias("_found"),
    )
    verdict = F.coalesce(F.col("_hit.verdict"), F.col("_found.verdict"), F.lit("allow"))
    return rows.join(hits, "_url", "left").select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_hit.rule").alias("rule"), verdict.alias("verdict"), F.col("_found.pattern").alias("pattern"))


def op5_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every page's url judged by HOST_RULES, then PATTERN_RULES."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    hosts = " UNION ALL ".join(f"SELECT {quote(h)} AS h, {quote(p)} AS p, {quote(v)} AS v" for h, p, v in HOST_RULES)
    patterns = " UNION ALL ".join(f"SELECT {quote(p)} AS pattern, {quote(v)} AS v" for p, v in PATTERN_RULES)
    return rf"""
WITH hr AS ({hosts}), pr AS ({patterns}),
rest AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
part AS (SELECT page_id, translate(url, '{_UPPER}', '{_LOWER}') AS low, translate(regexp_extract(r, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hit AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM part JOIN hr ON ends_with('.' || host, '.' || h) AND starts_with(path, p) AND host <> '' GROUP BY page_id),
found AS (SELECT page_id, max(pattern) AS pattern, 'block' AS v FROM part JOIN pr ON regexp_matches(low, pattern) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(hit.v, found.v, 'allow') AS verdict, pattern
FROM part LEFT JOIN hit USING (page_id) LEFT JOIN found USING (page_id)
"""


ORACLE_OP5 = _oracle()
