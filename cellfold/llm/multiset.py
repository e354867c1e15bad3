"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (a line of the text) hashes to a wide vector; a document's fingerprint
is the sum of its paragraphs' vectors, lane by lane, modulo 2**32. The order of
paragraphs plays no part, and a paragraph is added or taken away by adding or
subtracting its vector. There are two kinds of lanes:

* equality lanes: the words of the paragraph's SHA-512, uniform;
* likeness lanes: sums of signs hashed from the paragraph's word shingles. The
  squared length of the difference of two fingerprints then estimates how many
  shingles differ, so likeness 2<A,B> / (<A,A> + <B,B>) can be read off two fingerprints.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellfold.llm.shared import partitions

EQUAL_LANES = 16
LIKE_LANES = 64
MODULUS = 1 << 32
SHINGLE = 3
WORD = r"[^\x20\x09-\x0D]+"


def paragraphs(text: Column) -> Column:
    """The lines of a text; a null or empty text has none."""
    return F.when(F.length(text) > 0, F.split(text, "\n", -1)).otherwise(F.array().cast("array<string>"))


def equality_vector(text: Column) -> Column:
    """Array of ``EQUAL_LANES`` longs: SHA-512 words of the paragraphs, summed modulo 2**32."""
    digests = F.transform(paragraphs(text), lambda p: F.sha2(p, 512))
    lane = lambda d, i: F.conv(F.substring(d, 8 * i + 1, 8), 16, 10).cast("long")
    words = lambda d: F.array(*[lane(d, i) for i in range(EQUAL_LANES)])
    zero = F.array(*[F.lit(0).cast("long")] * EQUAL_LANES)
    return F.aggregate(digests, zero, lambda acc, d: add_vectors(acc, words(d)))


def add_vectors(a: Column, b: Column) -> Column:
    """Lane-wise sum modulo 2**32: the fingerprint of two multisets together."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(MODULUS)))


def subtract_vectors(a: Column, b: Column) -> Column:
    """Lane-wise difference modulo 2**32: a multiset without a part of it."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(MODULUS)))


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """XXH64 of each run of ``size`` words within a paragraph; a shorter paragraph is one shingle.

    Paragraphs without words have none. Repeats are kept.
    """
    words = F.filter(F.transform(paragraphs(text), lambda p: F.regexp_extract_all(p, F.lit(f"({WORD})"), 1)), lambda w: F.size(w) > 0)
    run = lambda w, i: F.xxhash64(F.array_join(F.slice(w, i, size), " "))
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1)))
    return F.flatten(F.transform(words, lambda w: F.transform(starts(w), lambda i: run(w, i))))


def fingerprint_text(lanes: Column) -> Column:
    """The lanes as 8 hex digits each, in a row."""
    return F.array_join(F.transform(lanes, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from likeness lanes of two documents: 1 if equal, about 0 if nothing is shared.

    Lanes are read as signed, from -2**31. Two documents without shingles are alike (1.0).
    """
    signed = lambda x: F.when(x >= MODULUS // 2, x - MODULUS).otherwise(x).cast("double")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: signed(p) * signed(q)), F.lit(0.0), lambda acc, v: acc + v)
    both = dot(a, a) + dot(b, b)
    return F.when(a == b, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(2 * dot(a, b), both), F.lit(0.0)))))


def fingerprint_pairs(rows: DataFrame, key: list[str], first: str, second: str) -> DataFrame:
    """``key`` columns, and arrays T_equal and T_like for the text columns T ``first`` and ``second``.

    ``key`` must tell rows apart. Both texts' shingles are exploded and summed by
    key; sums are partial in the task that read a row, so one narrow row per
    document is shuffled. A lane counts the set bits of its place in the shingles'
    hashes: the first text's in the low half of a long, the second's in the high half.
    Null and empty texts have zero vectors.
    """
    hashed = rows.select(*key, *[equality_vector(F.col(t)).alias(f"{t}_equal") for t in (first, second)], shingles(F.col(first)).alias("__a"), shingles(F.col(second)).alias("__b"))
    kept = [*key, f"{first}_equal", f"{second}_equal", "__na", "__nb"]
    opened = hashed.withColumns({"__na": F.size("__a"), "__nb": F.size("__b")}).select(*kept, F.posexplode_outer(F.concat("__a", "__b")).alias("__at", "__h"))
    part = F.when(F.col("__h").isNull(), 0).when(F.col("__at") < F.col("__na"), 1).otherwise(1 << 32).cast("long")
    opened = opened.select(*kept, F.coalesce("__h", F.lit(0)).alias("__h"), part.alias("__part"))
    lanes = [F.sum(F.shiftright("__h", i).bitwiseAND(F.lit(1).cast("long")) * F.col("__part")).alias(f"__{i}") for i in range(LIKE_LANES)]
    summed = opened.groupBy(*kept).agg(*lanes)
    # A lane is the sum of signs: set bits count +1, others -1.
    low = lambda i: F.col(f"__{i}").bitwiseAND(F.lit(MODULUS - 1))
    high = lambda i: F.shiftrightunsigned(f"__{i}", 32)
    like = lambda half, n: F.array(*[F.pmod(2 * half(i) - F.col(n), F.lit(MODULUS)) for i in range(LIKE_LANES)])
    return summed.select(*kept[:-2], like(low, "__na").alias(f"{first}_like"), like(high, "__nb").alias(f"{second}_like"))


class RangeBuckets:
    """Ranges of ids with about as many rows each, numbered in ascending order.

    Bounds are approximate quantiles over all rows, and so ids of the table: ids
    from ``bounds[i - 1]`` up to below ``bounds[i]`` are in bucket i. Null ids come
    first. A bucket is found in two steps of about the square root of the bounds.
    """

    def __init__(self, docs: DataFrame, id_col: str, buckets: int):
        self.id_col = id_col
        shares = [i / buckets for i in range(1, buckets)] or [0.5]
        row = docs.agg(F.percentile_approx(id_col, shares, max(10_000, 20 * buckets)), F.min(id_col), F.count(F.when(F.col(id_col).isNull(), 1))).first()
        self.least, nulls = row[1], row[2]
        self.bounds = sorted(set(row[0] or ())) if buckets > 1 else []
        self.first = 0 if nulls or not self.bounds or self.least < self.bounds[0] else 1
        self.firsts = [None if nulls else self.least] * (self.first == 0) + self.bounds

    def column(self) -> Column:
        if not self.bounds:
            return F.lit(0)
        step = max(1, round(len(self.bounds) ** 0.5))
        array = lambda xs: F.array(*[F.lit(x) for x in xs])
        below = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, b: acc + (b <= F.col(self.id_col)).cast("int"))
        head = below(array(self.bounds[::step]))
        groups = F.array(*[array(self.bounds[i : i + step]) for i in range(0, len(self.bounds), step)])
        inner = below(F.element_at(groups, F.greatest(head, F.lit(1))))
        return F.when(F.col(self.id_col).isNull() | (head == 0), 0).otherwise((head - 1) * step + inner)

    def is_first(self) -> Column:
        """Of a row: its id is the smallest of its bucket."""
        known = [x for x in self.firsts if x is not None]
        found = F.col(self.id_col).isin(known) if known else F.lit(False)
        return found | F.col(self.id_col).isNull() if None in self.firsts else found


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(bucket, at, last, id, text, next_text): each row with the text of the row after it.

    Rows are in ascending order of (id, text), null ids first; the last row's next
    is the first. One shuffle deals rows to ranges of ids. Each range also gets a
    copy of the next range's first row, marked ``last``; drop it after use.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    ranges = RangeBuckets(rows, "id", buckets or 4 * partitions(spark))
    own = ranges.column()
    before = F.when(own == ranges.first, len(ranges.bounds)).otherwise(own - 1)
    heads = rows.where(ranges.is_first()).groupBy(before.alias("bucket"), "id").agg(F.min("text").alias("text"))
    both = rows.select(own.alias("bucket"), F.lit(False).alias("last"), "id", "text").union(heads.select("bucket", F.lit(True), "id", "text"))
    order = Window.partitionBy("bucket").orderBy("last", F.asc_nulls_first("id"), "text")
    return both.select("bucket", F.row_number().over(order).alias("at"), "last", "id", "text", F.lead("text").over(order).alias("next_text"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses.

    The edited text has its last floor(n/2) code points replaced by the first as
    many (or all) of the next document's. Returns id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. Repeated rows stay
    (a row's next may be its repetition); null texts count as empty; an empty table
    gives an empty result; other columns are ignored.
    """
    rows = with_next(docs, id_col, text_col, buckets)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left(F.coalesce("next_text", F.lit("")), half))
    rows = rows.select("bucket", "at", "last", "id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    marked = fingerprint_pairs(rows, ["bucket", "at", "last", "id", "n_chars", "edited_sha256"], "text", "edited")
    order = Window.partitionBy("bucket").orderBy("at")
    marked = marked.withColumn("next_like", F.lead("text_like").over(order)).where("not last")
    return marked.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        fingerprint_text(F.concat("text_equal", "text_like")).alias("fingerprint"),
        fingerprint_text(F.concat("edited_equal", "edited_like")).alias("edited_fingerprint"),
        likeness(F.col("text_like"), F.col("edited_like")).alias("near_edited"),
        likeness(F.col("text_like"), F.col("next_like")).alias("near_next"),
    )
