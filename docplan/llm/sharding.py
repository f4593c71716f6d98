"""A reproducible shuffle into shards by a keyed Feistel permutation of global row numbers.

Law `rows`: shard sizes differ by one row at most. Shard and slot follow from a row's number, the
number of rows and the key alone; `place` computes them for any number without the table.

Rows are numbered by (bucket, doc_id, CRC, size): the bucket is a scrambled doc_id, buckets are
counted and numbered apart, so the numbering needs no global sort and depends on no partitioning.
Texts are read once;
only narrow rows (id, size, CRC) are written and shuffled. The bucket counts, BUCKETS rows at most,
are the only broadcast. All of it is DataFrame and SQL expressions.

Null texts have size 1 and the CRC of no bytes. Null ids are numbered first in bucket 0, split over
sub-buckets by CRC like all others. Repeated equal rows get numbers of their own; which of several
equal rows gets which is without effect. An empty table gives an empty result. Other columns of the
input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docplan.llm.common import settled

#: Buckets that are numbered apart; a bound of the broadcast, not of the rows in a bucket.
BUCKETS = 4096
ROUNDS = 6
#: Steps of the walk back into the range written out in the expression; see `permuted`.
WALK = 64
_MASK = 2147483647


def scramble(x: str, key: int, fold: str = "({a} ^ shiftright({a}, 15))") -> str:
    """SQL of a 31-bit mixture of a bigint expression; no step leaves 63 bits."""
    out = f"(({x}) & {_MASK})"
    for k in (key, key * 7 + 3, key * 13 + 5):
        out = f"(({out} * 1103515245 + {(k * 2654435761 + 12345) % _MASK}) & {_MASK})"
        out = fold.format(a=out) if k != key * 13 + 5 else out
    return out


def half_sizes(rows: int) -> tuple[int, int]:
    """Two factors whose product is the least rectangle of that shape holding all row numbers."""
    a = max(1, int(rows**0.5))
    while a * a < rows:
        a += 1
    return a, max(1, -(-rows // a))


def _once(x: str, a: int, b: int, key: int) -> str:
    """SQL of one pass of the network over x in [0, a * b); rounds are bound by nested transforms."""
    fold = (
        f"case when r % 2 = 0 then struct((h.l + f) % {a} as l, h.r as r) "
        f"else struct(h.l as l, (h.r + f) % {b} as r) end"
    )
    step = (
        "(h, r) -> element_at(transform(array(case when r % 2 = 0 then h.r else h.l end), "
        f"side -> element_at(transform(array({{f}}), f -> {fold}), 1)), 1)"
    ).replace("{f}", scramble(f"side * 31 + (r + 1) * {1 + key * 2}", key))
    start = f"struct(({x}) div {b} as l, ({x}) % {b} as r)"
    return f"aggregate(sequence(0L, {ROUNDS - 1}L), {start}, {step}, h -> h.l * {b} + h.r)"


def permuted(number: str, rows: int, key: int) -> str:
    """SQL of the permuted row number: the network, and again while it falls outside [0, rows).

    The rectangle exceeds `rows` by less than its side, so a second pass is rare. Of at most
    WALK numbers outside, no walk can be longer than WALK; of more, a longer one has a chance under
    side**-WALK and stops the job with an error instead of giving a wrong place.
    """
    a, b = half_sizes(rows)
    walk = _once("x", a, b, key)
    out = (
        f"aggregate(sequence(1, {WALK}), {_once(number, a, b, key)}, "
        f"(x, i) -> case when x < {rows} then x else {walk} end)"
    )
    return f"element_at(transform(array({out}), y -> case when y < {rows} then y else cast(raise_error('walk too long') as bigint) end), 1)"


def place(number: int, rows: int, key: int, shards: int) -> tuple[int, int]:
    """Shard and slot of one row number, without Spark."""

    def mixed(x: int, k0: int) -> int:
        x &= _MASK
        for k in (k0, k0 * 7 + 3, k0 * 13 + 5):
            x = (x * 1103515245 + (k * 2654435761 + 12345) % _MASK) & _MASK
            if k != k0 * 13 + 5:
                x ^= x >> 15
        return x

    a, b = half_sizes(rows)
    while True:
        left, right = divmod(number, b)
        for r in range(ROUNDS):
            f = mixed((right if r % 2 == 0 else left) * 31 + (r + 1) * (1 + key * 2), key)
            if r % 2 == 0:
                left = (left + f) % a
            else:
                right = (right + f) % b
        number = left * b + right
        if number < rows:
            return number % shards, number // shards


def shard(docs: DataFrame, shards: int = 16, key: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number and rows of every row."""
    narrow = settled(docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    ).withColumn("bucket", F.expr(f"cast({scramble('coalesce(doc_id, text_crc32)', 1)} % {BUCKETS} as int)")))
    counts = narrow.groupBy("bucket").count()
    rows = int(counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0])
    ahead = counts.select(  # BUCKETS rows at most
        "bucket", (F.sum("count").over(Window.orderBy("bucket")) - F.col("count")).alias("ahead"))
    numbered = narrow.join(F.broadcast(ahead), "bucket").select(
        "*", (F.col("ahead") + F.row_number().over(
            Window.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size")) - 1).alias("row_number"))
    if not rows:
        numbered = numbered.withColumn("permuted", F.lit(0).cast("bigint"))
    else:
        numbered = numbered.withColumn("permuted", F.expr(permuted("row_number", rows, key)))
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("permuted") % shards).cast("int").alias("shard"),
        F.expr(f"permuted div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number")
