"""Document fingerprints: threshold-scaled sketches of five-word shingles, in DataFrame functions only.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range.  Sketches of parts
unite to the sketch of the whole, and the overlap of two sketches estimates the overlap of the shingle sets
however unequal the documents are (FracMinHash; Irber et al., 2022).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: One in FRACTION of all hashes is kept.
FRACTION = 4
SHINGLE_WORDS = 5
#: Bound on the ranges of ids, whose bounds and first ids are sent to every executor; ids that are sampled for each bound.
MAX_RANGES, SAMPLE_PER_RANGE = 16_384, 12
RANGE_DOCS = (256, 8192)
#: Bounds of ranges in one branch of the table that finds a row's range.
FAN = 128


def shingle_hashes(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """Array of the 64-bit hashes of all ``size``-word windows; words are lower-cased and split at white space.

    A text of fewer words has one, its whole sequence; a null text or one without words has none.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - size)
        whole = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)]))
        return F.when(F.size(h) >= size, whole).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return _let(hashes, windows)


def sketch(text: Column, fraction: int = FRACTION) -> Column:
    """struct(n: windows of the text, head: hash of its whole window sequence, kept: sorted distinct hashes below the threshold)."""
    last = -(2**63) + 2**64 // fraction - 1

    def made(h: Column) -> Column:
        kept = F.array_sort(F.array_distinct(F.filter(h, lambda x: x <= F.lit(last))))
        return F.struct(F.size(h).cast("bigint").alias("n"), F.xxhash64(h).alias("head"), kept.alias("kept"))

    return _let(shingle_hashes(text), made)


def merged(a: Column, b: Column) -> Column:
    """Kept hashes of two texts taken together."""
    return F.array_sort(F.array_union(a["kept"], b["kept"]))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two sketches, 0 to 1.

    Sketches without kept hashes (very short texts) are alike only where the window sequences hash alike.
    """
    common = F.size(F.array_intersect(a["kept"], b["kept"]))
    union = F.size(a["kept"]) + F.size(b["kept"]) - common
    same = (a["n"] == b["n"]) & (a["head"] == b["head"])
    return F.when(same, F.lit(1.0)).when(union == 0, F.lit(0.0)).otherwise(common / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too."""
    return F.when(F.size(a["kept"]) > 0, F.size(F.array_intersect(a["kept"], b["kept"])) / F.size(a["kept"])).otherwise((a["head"] == b["head"]).cast("double"))


def text_form(s: Column) -> Column:
    """The sketch as a string: number of windows, their hash, and the kept hashes, in hexadecimal."""
    return F.concat_ws(":", s["n"].cast("string"), F.hex(s["head"]), F.array_join(F.transform(s["kept"], lambda h: F.hex(h)), ","))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``next_text``: the text of the next row by ascending id, and of the first row for the last.

    Null ids come first; rows of one id follow the hash of their texts.  Rows are dealt to ranges of that order, whose
    bounds come from a sample by hash, so that ids of any kind and spread, and many rows of one id, fall into
    about equal ranges.  The first rows of a range are also given to the range before it, so that each range finds its rows'
    successors alone and the texts are shuffled once.  Equal rows of one id and text share a range.
    """
    spark = docs.sparkSession
    place = F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"))
    n = docs.count()
    at_once = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per = min(max(n // (8 * at_once), RANGE_DOCS[0]), RANGE_DOCS[1])
    ranges = max(1, min(MAX_RANGES, -(-n // per)))
    rate = min(1.0, SAMPLE_PER_RANGE * ranges / max(n, 1))
    sample = docs.select(place.alias("p")).filter(F.pmod(F.xxhash64(F.lit(29), F.col("p.i"), F.col("p.h")), F.lit(1 << 30)) < rate * (1 << 30))
    sample = sorted({(r.p.i is not None, r.p.i, r.p.h) for r in sample.distinct().collect()}, key=lambda r: (r[0], r[1] if r[0] else 0, r[2]))  # SAMPLE_PER_RANGE * MAX_RANGES at most, in expectation
    cuts = [sample[len(sample) * k // ranges][1:] for k in range(1, ranges)] if len(sample) >= ranges else [x[1:] for x in sample]
    cuts = list(dict.fromkeys(cuts))
    kind = f"struct<i:{docs.schema[id_col].dataType.simpleString()},h:bigint>"
    tree = [cuts[k : k + FAN] for k in range(0, len(cuts), FAN)]
    tops = [t[-1] for t in tree]
    bounds = F.broadcast(spark.createDataFrame([(tops, tree)], f"nx_tops array<{kind}>, nx_tree array<array<{kind}>>"))
    dealt = docs.withColumn("nx_place", place).join(bounds)
    branch = F.size(F.filter("nx_tops", lambda x: x < F.col("nx_place")))
    within = F.size(F.filter(F.coalesce(F.get("nx_tree", branch), F.array().cast(f"array<{kind}>")), lambda x: x < F.col("nx_place")))
    dealt = dealt.withColumn("nx_b", (branch * FAN + within).cast("bigint")).drop("nx_tops", "nx_tree")

    firsts = dealt.groupBy("nx_b").agg(F.min("nx_place").alias("f")).orderBy("nx_b").collect()  # MAX_RANGES rows at most
    rows = [(r.nx_b, r.f, firsts[i - 1].nx_b, i == 0) for i, r in enumerate(firsts)]
    edges = F.broadcast(spark.createDataFrame(rows, f"nx_b bigint, nx_first {kind}, nx_before bigint, nx_wraps boolean"))
    dealt = dealt.join(edges, "nx_b")
    own = F.struct(F.col("nx_b").alias("b"), F.lit(False).alias("ghost"), F.lit(False).alias("wraps"))
    ghost = F.struct(F.col("nx_before").alias("b"), F.lit(True).alias("ghost"), F.col("nx_wraps").alias("wraps"))
    copies = F.when(F.col("nx_place") == F.col("nx_first"), F.array(own, ghost)).otherwise(F.array(own))
    dealt = dealt.withColumn("nx", F.explode(copies)).withColumns({"nx_b": F.col("nx.b"), "nx_ghost": F.col("nx.ghost"), "nx_wraps": F.col("nx.wraps"), "nx_hash": F.col("nx_place.h")}).drop("nx", "nx_place", "nx_first")
    # A row handed down from the range above comes after the range's own rows.
    order = Window.partitionBy("nx_b").orderBy("nx_wraps", "nx_ghost", F.col(id_col).asc_nulls_first(), "nx_hash")
    return dealt.withColumn("next_text", F.lead(F.coalesce(F.col(text_col), F.lit(""))).over(order))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: int = FRACTION) -> DataFrame:
    """Sketches of every text and of its edited text, and their likeness.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the
    next document's.  Returns id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``.  A null text counts as empty; repeated rows follow one another; an empty table gives
    an empty one; a table of one row has itself as its next row.  Other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pairs = with_next(source, "id", "text")
    order = Window.partitionBy("nx_b").orderBy("nx_wraps", "nx_ghost", F.col("id").asc_nulls_first(), "nx_hash")
    pairs = pairs.withColumn("own", sketch(F.col("text"), fraction)).withColumn("after", F.lead("own").over(order)).filter(~F.col("nx_ghost"))
    cut = F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 4) as int))"), F.substring("next_text", F.lit(1), cut))
    pairs = pairs.select("id", F.char_length("text").cast("bigint").alias("n_chars"), "own", "after", edited.alias("edited"))
    pairs = pairs.select("id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "after", sketch(F.col("edited"), fraction).alias("other"))
    own, other, after = F.col("own"), F.col("other"), F.col("after")
    return pairs.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", text_form(own).alias("fingerprint"), text_form(other).alias("edited_fingerprint"), likeness(own, other).alias("near_edited"), likeness(own, after).alias("near_next"))
