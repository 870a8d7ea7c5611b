"""URL filters: rules by host and path, and a ratio of character language models for urls without a rule.

Urls that a rule allows or blocks train two variable-order Markov models over the characters of host and path.  A character is predicted from
up to ``ORDER`` characters before it: at each length the estimate of the next shorter context is mixed in by the number of different characters seen
behind the context (Witten-Bell), and a context that was never seen leaves the shorter one's estimate, so the order varies with what was
seen.  The score of a url is the difference of its log-likelihoods under the two models divided by its length.
The threshold is the one that parts allowed and blocked urls best (mean of both rates) when each half is scored by models of the other half.

Counts are kept for windows of ``ORDER`` + 1 characters by verdict and half; shorter windows are sums of longer ones.  The
estimates are built level by level: a window of k + 1 characters meets its last k, so a key has at most as many rows as there are characters.
Windows that are frequent, at most ``FREQUENT`` of them by arithmetic, are sent to all tasks to score urls, and the others meet theirs in a
shuffled join that no frequent key is left in.  Everything is built-in functions; log-likelihoods are summed as whole numbers of 1e-9, so sums do not depend on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Characters of context; the alphabet that unseen characters are drawn from.
ORDER, ALPHABET = 4, 256
#: Marks before and after a url.
BEGIN, END = "\x02", "\x03"
#: A window with at least this share of all places is frequent: there are at most FREQUENT of them.
FREQUENT = 1 << 16
#: Scores are told apart in steps of 1/STEPS between -RANGE and RANGE when the threshold is placed.
STEPS, RANGE = 100, 20
#: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def parted(url: str) -> tuple[Column, Column]:
    """(host, path) of a url column; both empty without ``://``."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def ruled(rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits columns ``host`` and ``path``; null where none does.

    The longest is by characters of host and path together, then of the host; of rules equal in that the first.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    rule = verdict = None
    for decided, host, path in ordered:
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, decided) if verdict is None else verdict.when(fits, decided)
    return rule, verdict


def _windows(urls: DataFrame) -> DataFrame:
    """A row for each character of a url and its end: the window that ends there."""
    padded = F.concat(F.lit(BEGIN * ORDER), "host", "path", F.lit(END))
    return urls.select("url", "size", F.explode(F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))).alias("w"), "weight", "verdict", "half")


#: Models: of all urls, of the second half and of the first half.
MODELS = {"all": ("0", "1"), "0": ("1",), "1": ("0",)}
COUNTS = ["allow0", "allow1", "block0", "block1"]


def _estimates(counts: DataFrame) -> DataFrame:
    """(w, ``all``, ``0``, ``1``): differences of log-estimates in 1e-9, of every window, by model; from counts of windows."""
    level = [f"{v}_{m}" for v in ("allow", "block") for m in MODELS]
    known = None
    for length in range(1, ORDER + 2):
        grams = counts.groupBy(F.substring("w", ORDER + 2 - length, length).alias("g")).agg(*[F.sum(c).alias(c) for c in COUNTS])
        of = {f"{v}_{m}": sum((F.col(f"{v}{h}") for h in halves), F.lit(0)) for v in ("allow", "block") for m, halves in MODELS.items()}
        grams = grams.select("g", F.substring("g", 1, length - 1).alias("context"), F.substring("g", 2, length - 1).alias("tail"), *[c.alias(f"n_{k}") for k, c in of.items()])
        behind = grams.groupBy(F.col("context").alias("c_context")).agg(*[F.sum(f"n_{k}").alias(f"s_{k}") for k in level], *[F.sum((F.col(f"n_{k}") > 0).cast("bigint")).alias(f"t_{k}") for k in level])
        joined = grams.join(behind, F.col("context") == F.col("c_context"))
        if known is not None:
            joined = joined.join(known, F.col("tail") == F.col("k_g"))
        estimates = []
        for k in level:
            shorter = F.lit(1.0 / ALPHABET) if known is None else F.col(f"k_{k}")
            seen, kinds = F.col(f"s_{k}"), F.col(f"t_{k}")
            estimates.append(F.when(seen > 0, (F.col(f"n_{k}") + kinds * shorter) / (seen + kinds)).otherwise(shorter).alias(f"k_{k}"))
        known = joined.select(F.col("g").alias("k_g"), *estimates)
    ratio = [F.round((F.log(f"k_allow_{m}") - F.log(f"k_block_{m}")) * 1e9).cast("bigint").alias(m) for m in MODELS]
    return known.select(F.col("k_g").alias("w"), *ratio)


def scored(urls: DataFrame) -> DataFrame:
    """``all``, ``0`` and ``1``: sums of 1e-9 of log-likelihood differences of each distinct url by model; from (url, host, path, weight, verdict, half, size)."""
    windows = _windows(urls)
    labelled = lambda v, h: F.sum(F.when((F.col("verdict") == v) & (F.col("half") == h), F.col("weight")).otherwise(0)).alias(f"{v}{h}")
    counts = checkpointed(windows.groupBy("w").agg(F.count("*").alias("places"), *[labelled(v, h) for v in ("allow", "block") for h in (0, 1)]))
    places = counts.agg(F.sum("places")).first()[0] or 0
    model = checkpointed(_estimates(counts).join(counts.select(F.col("w").alias("c_w"), "places"), F.col("w") == F.col("c_w")).drop("c_w"))
    often = F.col("places") >= max(1, -(-places // FREQUENT))
    names = list(MODELS)
    frequent = model.filter(often).select(F.col("w").alias("m_w"), *names)
    met = windows.select("url", "w").join(F.broadcast(frequent), F.col("w") == F.col("m_w"), "left")
    rest = met.filter(F.col("m_w").isNull()).groupBy("url", "w").agg(F.count("*").alias("n")).join(model.filter(~often).select(F.col("w").alias("r_w"), *names), F.col("w") == F.col("r_w"))
    parts = met.filter(F.col("m_w").isNotNull()).select("url", *names).unionByName(rest.select("url", *[(F.col(m) * F.col("n")).alias(m) for m in names]))
    return parts.groupBy("url").agg(*[F.sum(m).alias(m) for m in names])


def threshold(bins: list[tuple[int, int, int]]) -> float:
    """From (step, allowed, blocked) of held-out urls, the score from which on urls are allowed.

    It has the highest mean rate of allowed urls at or above it and blocked ones below it; of equal ones the one
    nearest to zero, then the lower.  Without both kinds it is zero.
    """
    allowed, blocked = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not allowed or not blocked:
        return 0.0
    best, under_a, under_b = None, 0, 0
    for step, a, b in [*sorted(bins), (RANGE * STEPS + 1, 0, 0)]:
        rate = (allowed - under_a) * blocked + under_b * allowed
        key = (-rate, abs(step), step)
        best = key if best is None else min(best, key)
        under_a, under_b = under_a + a, under_b + b
    return best[2] / STEPS


def judged(pages: DataFrame, url_col: str = "url", id_col: str = "page_id", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per row of ``pages``: the id, ``host``, ``path``, ``rule``, ``verdict``, ``score`` (the length-normalised difference) and ``bound``, the threshold.

    A url that is null or without ``://`` has an empty host and path, and is judged by the models as such.  Equal urls are judged alike and
    count as often as they occur.  Where rules allow or block no url at all both models are as good as the other: every score is that of
    the one model there is, against zero.  An empty table gives an empty one; other columns are not read.
    """
    source = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    distinct = source.groupBy("url").agg(F.count("*").alias("weight"))
    host, path = parted("url")
    rule, verdict = ruled(rules)
    urls = distinct.select("url", "weight", host.alias("host"), path.alias("path"), F.when(F.sha2("url", 256) < "8", 0).otherwise(1).alias("half"))
    urls = checkpointed(urls.select("*", rule.alias("rule"), verdict.alias("verdict"), (F.length(F.concat("host", "path")) + 1).alias("size")))
    found = checkpointed(urls.join(scored(urls).withColumnRenamed("url", "s_url"), F.col("url") == F.col("s_url")).drop("s_url"))
    step = F.least(F.greatest(F.floor(F.when(F.col("half") == 0, F.col("0")).otherwise(F.col("1")) / F.col("size") / 1e9 * STEPS), F.lit(-RANGE * STEPS)), F.lit(RANGE * STEPS))
    kinds = [F.sum(F.when(F.col("verdict") == v, F.col("weight")).otherwise(0)).alias(v) for v in ("allow", "block")]
    bins = found.filter(F.col("verdict").isNotNull()).groupBy(step.alias("step")).agg(*kinds).collect()  # 2 * RANGE * STEPS + 1 rows at most
    bound = threshold([tuple(b) for b in bins])
    score = F.col("all") / F.col("size") / 1e9
    decided = F.coalesce("verdict", F.when(score >= bound, "allow").otherwise("block"))
    by_url = found.select(F.col("url").alias("f_url"), "host", "path", "rule", decided.alias("verdict"), score.alias("score"), F.lit(bound).alias("bound"))
    return source.join(by_url, F.col("url") == F.col("f_url")).select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "score", "bound")
