"""Order MinHash fingerprints as Spark expressions only.

k-mers are runs of K words, numbered by occurrence, so repeats count. Each numbered k-mer is hashed
once; the hash's first bits deal it to one of BUCKETS. In each bucket the L smallest are selected,
put back into text order and hashed as a tuple. Moved or edited text changes k-mers or their
order, so the share of equal tuples falls with edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, L, BUCKET_BITS = 2, 2, 6
#: Bits of a sort key that hold a position; texts of more words share the last ones by modulo.
AT_BITS = 24
AT = (1 << AT_BITS) - 1
#: Documents of so many neighbouring ids are ordered together.
RANGE_BITS = 12


def let(name: str, value: str, body: str) -> str:
    """body with name bound to value, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def signature(text: str) -> Column:
    """Sorted array<long>: bucket in the upper half, hash of its tuple in the lower."""
    steps = ", ".join(str(1 << b) for b in range(AT_BITS - 1, -1, -1))
    top = 64 - BUCKET_BITS
    high = lambda x: f"shiftright({x}, {AT_BITS})"
    bucket = lambda x: f"shiftright({x}, {top})"
    mers = f"IF(size(w) = 0, array(xxhash64({text})), transform(sequence(0, greatest(size(w) - {K}, 0)), i -> xxhash64({', '.join(f'get(w, i + {k})' for k in range(K))})))"
    keyed = f"sort_array(transform(h, (x, i) -> (x & {~AT}L) | cast(i & {AT} AS BIGINT)))"
    # In the sorted keys, the number of equal k-mers before one: doubling steps backwards.
    before = f"IF({high('get(s, i - 1)')} <=> {high('x')}, aggregate(array({steps}), 0, (n, b) -> IF({high('get(s, i - n - b)')} <=> {high('x')}, n + b, n)), 0)"
    numbered = f"sort_array(transform(s, (x, i) -> (xxhash64({high('x')}, {before}) & {~AT}L) | (x & {AT}L)))"
    least = f"filter(t, (x, i) -> NOT ({bucket(f'get(t, i - {L})')} <=> {bucket('x')}))"
    pair = f"IF(NOT ({bucket('y')} <=> {bucket('x')}), xxhash64({high('x')}), IF((x & {AT}L) < (y & {AT}L), xxhash64({high('x')}, {high('y')}), xxhash64({high('y')}, {high('x')})))"
    tuples = f"filter(transform(m, (x, i) -> IF({bucket('get(m, i - 1)')} <=> {bucket('x')}, NULL, shiftleft(shiftrightunsigned(x, {top}), 32) | ({let('y', 'get(m, i + 1)', pair)} & 4294967295L))), x -> x IS NOT NULL)"
    words = f"filter(split({text}, '[ \\\\t-\\\\r]+'), x -> x != '')"
    return F.expr(let("w", words, let("h", mers, let("s", keyed, let("t", numbered, let("m", least, tuples))))))


def likeness(a: str, b: str) -> Column:
    """Equal tuples by buckets that either has filled; 0 to 1."""
    place = lambda x: f"transform({x}, x -> shiftright(x, 32))"
    return F.expr(f"size(array_intersect({a}, {b})) / cast(size({a}) + size({b}) - size(array_intersect({place(a)}, {place(b)})) AS DOUBLE)")


def printed(sig: str) -> Column:
    return F.expr(f"concat_ws('', transform({sig}, x -> lpad(lower(hex(x)), 10, '0')))")


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with key, place and the text of the next document by descending id.

    Ids are ordered inside ranges of ids; the last row of a range gets the first row of the next
    range that has rows, from a table of one row per range. The last document of all gets the
    first. Null ids come last; equal ids are ordered by text.
    """
    low = F.lit(-(1 << 62))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.coalesce(F.shiftright("doc_id", RANGE_BITS), low))
    order = Window.partitionBy("key").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    rows = rows.select("*", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("own_next"))
    first = rows.where("place = 1").select("key", F.col("text").alias("first_text"))
    keys = first.select("key", F.lead("key").over(Window.orderBy(F.desc("key"))).alias("next_key"), F.max("key").over(Window.orderBy(F.desc("key"))).alias("top"))
    ends = keys.select("key", F.coalesce("next_key", "top").alias("next_key")).join(first.withColumnRenamed("key", "next_key"), "next_key").select("key", "first_text")
    ends = ends.withColumn("first_sig", signature("first_text"))
    return rows.join(ends, "key", "left").withColumn("next_text", F.coalesce("own_next", "first_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs: fingerprints of its text and of its edited text, and their likeness.

    Null is empty. A text without words is one k-mer of itself; one with a word fewer than K is
    one k-mer. A lone row is its own next document. An empty table gives no rows.
    """
    n = F.char_length("text")
    edited = F.expr("concat(left(text, char_length(text) - char_length(text) div 3), left(next_text, cast(char_length(text) div 3 AS INT)))")
    rows = with_next(docs).select("doc_id", "key", "place", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "first_sig")
    rows = rows.select(
        "doc_id", "key", "place", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), signature("text").alias("sig"), signature("edited").alias("edited_sig"), "first_sig",
    )
    after = F.coalesce(F.lead("sig").over(Window.partitionBy("key").orderBy("place")), "first_sig")
    rows = rows.select("*", after.alias("next_sig"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", printed("sig").alias("fingerprint"), printed("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"),
    )
