"""Near copies by Order MinHash: sketches keep the text order of sampled shingles, candidates are
verified by banded alignment.

Texts are lower-case words without punctuation. Texts of equal word sequence form one node. Each of
SKETCHES sketches of a node samples the least of its shingles of WIDTH words (NARROW ones in texts under BRIEF words), labelled with
their occurrence so that repetitions count, and hashes them in their order in the text. A sketch has
three depths, of 2, 5 and 12 shingles, each a refinement of the one before: a forest. In a first
round every node meets the least node of its buckets, of the next depth too where a bucket has more than
SMALL nodes; this makes a group of near copies one class. In a second round all nodes of a bucket of the
first depth that are of different classes meet, whatever its size: larger buckets are cut into blocks, whose
comparisons grow with the product of their nodes and those outside their largest class. Texts under
ten words differ by one word at most; their buckets are their sequences less one word,
which finds every such pair.

Candidates of unlike length or word profile (128 one-bit minima, which 3.5 standard deviations apart
cannot belong to similar texts) are left out. A pair is similar if the edit distance of its word
sequences is at most (1 - THRESHOLD) of the longer one. The alignment walks the furthest points of the diagonals of a
band that widens with the distance, so near copies cost little; a bound from the common words rejects
most others first. Classes are the connected components of similar pairs, found with written intermediate results.

Null and empty texts form one node, texts under five words match equal ones only. Repeated rows are
members of the same node. An empty table gives an empty result. Columns other than id and text are
not read. Shuffled are node keys, sketches, and 32-bit word codes of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docplan.llm import vec
from docplan.llm.common import free_name, settled

WIDTH, NARROW, BRIEF = 3, 2, 20
SKETCHES, THRESHOLD = 24, 0.8
#: Sampled shingles of each depth of a sketch.
DEPTHS = (2, 5, 12)
#: Buckets of more nodes are split by the next depth.
SMALL = 64
#: Nodes of a block of a large bucket.
BLOCK = 1024
#: Texts of fewer words are found by their sequences less one word, and of fewer than LEAST by equality.
SHORT, LEAST = 10, 5
#: One-bit minima of a word profile.
PROFILE = 128

_rng = np.random.default_rng(4)
_FACTORS = _rng.integers(1, 1 << 63, SKETCHES, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _rng.integers(1, 1 << 63, SKETCHES, dtype=np.uint64)
_PROFILE_FACTORS = _rng.integers(1, 1 << 63, PROFILE, dtype=np.uint64) | np.uint64(1)
_PROFILE_SHIFTS = _rng.integers(1, 1 << 63, PROFILE, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _sequence_keys(key: np.ndarray, words: vec.Words) -> list[bytes]:
    """16 bytes of each row's word sequence."""
    place = (np.arange(len(words)) - words.first[words.row]).astype(np.uint64)
    out = []
    for salt in (1, 2):
        each = np.concatenate([vec.mix((key + np.uint64(salt)) ^ vec.mix(place * _STEP + np.uint64(salt))), np.zeros(1, np.uint64)])
        sums = np.add.reduceat(each, np.minimum(words.first, len(words))) if len(words.first) else each[:0]
        sums = np.where(words.per_row > 0, sums, 0)
        out.append(vec.mix(sums + words.per_row.astype(np.uint64)))
    both = np.ascontiguousarray(np.stack(out, axis=1)).view(np.uint8).reshape(-1, 16)
    return [row.tobytes() for row in both]


def order_min_hash(shingles: np.ndarray, labelled: np.ndarray) -> np.ndarray:
    """The sketches of one text, a row for each depth: hashes of its sampled shingles in text order."""
    n = len(shingles)
    counts = [min(d, n) for d in DEPTHS]
    ranks = labelled[None, :] * _FACTORS[:, None] + _SHIFTS[:, None]
    at = np.argpartition(ranks, sorted({c - 1 for c in counts}), axis=1)[:, : counts[-1]]
    out = np.empty((len(DEPTHS), SKETCHES), np.uint64)
    for k, count in enumerate(counts):
        chosen = np.sort(at[:, :count], axis=1)
        name = np.arange(SKETCHES, dtype=np.uint64) + np.uint64(SKETCHES * k)
        for j in range(count):
            name = name * _STEP + shingles[chosen[:, j]]
        out[k] = name
    return vec.mix(out)


def less_one(key: np.ndarray) -> np.ndarray:
    """Buckets of a short text, a row for each depth: its words less each one, and then the place too."""
    n = len(key)
    place = np.arange(n + 1)  # the one left out; n: none
    seen = np.where(place < n, n - 1, n).astype(np.uint64)
    for k in range(n):
        seen = np.where(place == k, seen, vec.mix(seen * _STEP + key[k : k + 1]))
    names, first = np.unique(seen, return_index=True)
    deeper = vec.mix(names + vec.mix((place[first] + n).astype(np.uint64)))
    return np.stack([names, deeper, vec.mix(deeper)])


def profiles(key: np.ndarray, words: vec.Words, rows: int) -> np.ndarray:
    """Two 64-bit numbers of each row: one bit of each of the PROFILE minima of its labelled words."""
    out = np.zeros((rows, PROFILE), np.uint8)
    some = np.flatnonzero(words.per_row)
    if len(some):
        labelled = _labels(key, words.row)
        begin = words.first[some]
        for k in range(PROFILE):
            least = np.minimum.reduceat(labelled * _PROFILE_FACTORS[k] + _PROFILE_SHIFTS[k], begin)
            out[some, k] = (vec.mix(least) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(out, axis=1).view(np.int64)


def _labels(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Scrambled (value, how many times it came before in its row)."""
    mixed = vec.mix(values + row.astype(np.uint64) * _STEP)
    order = np.argsort(mixed, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = mixed[order][1:] != mixed[order][:-1]
    begin = np.flatnonzero(new)
    seen = np.zeros(len(order), np.uint64)
    seen[order] = (np.arange(len(order)) - begin[np.cumsum(new) - 1]).astype(np.uint64)
    return vec.mix(values ^ vec.mix(seen + np.uint64(7)))


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, node, n_words, profile and buckets (each a struct of its depths) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in vec.pieces(batch, "text", 1 << 18):
                data = vec.folded(p)
                w = vec.words(p, vec.BREAK, data)
                key = vec.hashes(data, w.start, w.end)
                names = _sequence_keys(key, w)
                shingles = {}
                for width in (WIDTH, NARROW):
                    shingle = vec.runs(key, width)
                    shingles[width] = shingle, _labels(shingle, w.row[: len(shingle)])
                sketches = []
                for r in range(p.rows):
                    lo, n = int(w.first[r]), int(w.per_row[r])
                    if n >= SHORT:
                        width = WIDTH if n >= BRIEF else NARROW
                        sketches.append(order_min_hash(*(values[lo : lo + n - width + 1] for values in shingles[width])))
                    else:
                        sketches.append(less_one(key[lo : lo + n]) if n >= LEAST else np.zeros((len(DEPTHS), 0), np.uint64))
                ends = np.concatenate([[0], np.cumsum([s.shape[1] for s in sketches])]).astype(np.int32)
                levels = np.concatenate(sketches, axis=1).view(np.int64)
                buckets = pa.StructArray.from_arrays([pa.array(level) for level in levels], [f"b{k}" for k in range(len(DEPTHS))])
                profile = profiles(key, w, p.rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(p.first, p.rows), pa.array(names, pa.binary()), pa.array(w.per_row.astype(np.int64)),
                     pa.array(profile[:, 0]), pa.array(profile[:, 1]), pa.ListArray.from_arrays(pa.array(ends), buckets)],
                    ["doc_id", "node", "n_words", "p0", "p1", "buckets"])

    depths = ", ".join(f"b{k}: bigint" for k in range(len(DEPTHS)))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, f"doc_id bigint, node binary, n_words bigint, p0 bigint, p1 bigint, buckets array<struct<{depths}>>")


def with_node(docs: DataFrame, name: str, codes: str | None = None) -> DataFrame:
    """The rows, all columns, with their node and, if named, the 32-bit codes of their words."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, coded = [], []
            for p in vec.pieces(batch, "text", 1 << 18):
                data = vec.folded(p)
                w = vec.words(p, vec.BREAK, data)
                key = vec.hashes(data, w.start, w.end)
                found += _sequence_keys(key, w)
                if codes:
                    raw = (key >> np.uint64(32)).astype(np.uint32).tobytes()
                    coded += [raw[4 * a : 4 * (a + n)] for a, n in zip(w.first.tolist(), w.per_row.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.binary()), *([pa.array(coded, pa.binary())] if codes else [])],
                [*names, name, *([codes] if codes else [])])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, `{name}` binary" + (f", `{codes}` binary" if codes else ""))


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """The edit distance of two sequences, or limit + 1 if it is larger: furthest points by diagonal."""
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return limit + 1
    power = vec.powers(int(_STEP), max(n, m) + 1)

    def prefix(x: np.ndarray) -> np.ndarray:
        # H[i] * step**(len - i) differences compare runs at different places
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(vec.mix(x.astype(np.uint64)) * power[: len(x)])])

    ha, hb = prefix(a), prefix(b)
    top = 1 << max(n, m).bit_length()

    def run(i: int, j: int) -> int:
        begin, step = i, 64
        while i < n and j < m:
            x, y = a[i : i + step], b[j : j + step]
            size = min(len(x), len(y))
            other = x[:size] != y[:size]
            if other.any():
                return i + int(other.argmax()) - begin
            i, j, step = i + size, j + size, step * 4
        return i - begin

    def same(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far a[i:] and b[j:] agree."""
        length = np.zeros(len(i), np.int64)
        at = np.flatnonzero((i < n) & (j < m))
        at = at[a[i[at]] == b[j[at]]]
        if len(at) <= 16:
            for k in at.tolist():
                length[k] = run(int(i[k]), int(j[k]))
        else:
            length[at] = lifted(i[at], j[at])
        return length

    def lifted(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        length = np.zeros(len(i), np.int64)
        step = top
        while step:
            longer = length + step
            fits = (i + longer <= n) & (j + longer <= m)
            x, y = i[fits], j[fits]
            da = (ha[x + longer[fits]] - ha[x]) * power[np.maximum(y - x, 0)]
            db = (hb[y + longer[fits]] - hb[y]) * power[np.maximum(x - y, 0)]
            equal = np.zeros(len(i), bool)
            equal[fits] = da == db
            length[equal] = longer[equal]
            step >>= 1
        return length

    far = same(np.zeros(1, np.int64), np.zeros(1, np.int64))  # furthest a-index on diagonals -e..e (b - a)
    for e in range(limit + 1):
        if abs(m - n) <= e and far[m - n + e] >= n:
            return e
        wide = np.full(2 * e + 5, -(1 << 40), np.int64)
        wide[2:-2] = far
        k = np.arange(-e - 1, e + 2)
        best = np.maximum(np.maximum(wide[1:-1] + 1, wide[2:] + 1), wide[:-2])  # substitute, delete from a, insert from b
        best = np.minimum(best, np.minimum(n, m - k))
        ok = (best >= 0) & (best + k >= 0)
        far = np.full(2 * e + 3, -(1 << 40), np.int64)
        far[ok] = best[ok] + same(best[ok], best[ok] + k[ok])
    return limit + 1


def alike(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    longer = max(len(a), len(b))
    limit = int((1 - threshold) * longer + 1e-9)
    if abs(len(a) - len(b)) > limit:
        return False
    ka, ca = np.unique(a, return_counts=True)
    kb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if longer - int(np.minimum(ca[ia], cb[ib]).sum()) > limit:
        return False
    return edit_distance(a, b, limit) <= limit


def _verified(pairs: DataFrame, codes: DataFrame, threshold: float) -> DataFrame:
    """The nodes a and b of the pairs (n_a, n_b) whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ca, cb = batch.column(2), batch.column(3)
            good = [alike(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32), threshold) for x, y in zip(ca, cb)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda end: codes.select(F.col("n").alias(f"n_{end}"), F.col("node").alias(end), F.col("codes").alias(f"codes_{end}"))
    both = pairs.join(side("a"), "n_a").join(side("b"), "n_b")
    return both.select("a", "b", "codes_a", "codes_b").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node and label of all ends of the edges (a, b), one label for each component.

    By contraction: every node points to its least neighbour or itself, and the edges between what
    their ends point to are the next ones. Node keys are scrambled, so each round leaves a fraction.
    """
    edges = settled(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct())
    labels = None
    while True:
        ends = edges.select("a", "b").union(edges.select("b", "a"))
        up = settled(ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")))
        if labels is None:
            labels = up.withColumnRenamed("to", "label")
        else:
            labels = settled(labels.join(up.withColumnRenamed("node", "label"), "label", "left").select(
                "node", F.coalesce("to", "label").alias("label")))
        to = lambda end: up.select(F.col("node").alias(end), F.col("to").alias(f"to_{end}"))
        edges = settled(edges.join(to("a"), "a").join(to("b"), "b").where("to_a != to_b").select(
            F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        if not edges.limit(1).count():
            return labels


def _pair(x: str | F.Column, y: str | F.Column) -> tuple[F.Column, F.Column]:
    return F.least(x, y).alias("n_a"), F.greatest(x, y).alias("n_b")


def buckets(each: DataFrame) -> list[DataFrame]:
    """n, bucket, size and the least n of the shared buckets of each depth."""
    members, out = each.select("n", F.explode("buckets").alias("b")).select("n", "b.*"), []
    for depth in range(len(DEPTHS)):
        name = f"b{depth}"
        found = members.groupBy(name).agg(F.count("*").alias("size"), F.min("n").alias("least")).where("size > 1")
        out.append(settled(members.join(found, name)))
        members = out[-1].where(f"size > {SMALL}").select("n", *[f"b{k}" for k in range(depth + 1, len(DEPTHS))])
    return [held.select("n", F.col(f"b{k}").alias("bucket"), "size", "least") for k, held in enumerate(out)]


def led(shared: list[DataFrame]) -> DataFrame:
    """Pairs of every node and the least one of its buckets."""
    return reduce(DataFrame.unionByName, (b.where("n != least").select(*_pair("n", "least")) for b in shared)).distinct()


def unlike(shared: DataFrame, labels: DataFrame, each: DataFrame, threshold: float) -> DataFrame:
    """Pairs of nodes of different classes so far that share a bucket: all of them, in large buckets those that
    `_sifted` would keep.

    Large buckets are compared in blocks: the nodes outside their largest class with all nodes.
    """
    known = labels.select(F.xxhash64("node").alias("n"), F.xxhash64("label").alias("known"))
    rows = settled(shared.where("size > 2").join(known, "n", "left").select("n", "bucket", "size", F.coalesce("known", "n").alias("label")))
    several = rows.groupBy("bucket", "label").agg(F.count("*").alias("held")).groupBy("bucket").agg(
        F.max(F.struct("held", "label")).alias("main"), F.sum("held").alias("all")).where("main.held < all")
    open_ = settled(rows.join(several.select("bucket", F.col("main.label").alias("main"), (F.col("all") - F.col("main.held")).alias("others")), "bucket"))
    together = open_.where(f"size <= {SMALL}").groupBy("bucket").agg(F.sort_array(F.collect_set(F.struct("n", "label"))).alias("ns"))  # SMALL at most
    pairs = together.selectExpr(
        "inline(flatten(transform(sequence(1, size(ns) - 1), i -> transform(filter(slice(ns, i + 1, size(ns)), m -> m.label != ns[i - 1].label), m -> "
        "struct(ns[i - 1].n as n_a, m.n as n_b)))))")
    large = settled(open_.where(f"size > {SMALL}").join(each, "n"))
    return pairs.unionByName(_in_blocks(large, threshold)).distinct()


def _in_blocks(large: DataFrame, threshold: float) -> DataFrame:
    """Pairs that `_sifted` keeps of each bucket's nodes outside the main class with its nodes of other classes than theirs.

    Both sides are dealt to blocks of about BLOCK nodes by their scrambled n, and every block meets every other.
    """
    told = large.withColumns({"ups": F.ceil(F.col("others") / BLOCK).cast("int"), "downs": F.ceil(F.col("size") / BLOCK).cast("int")})
    columns = ["bucket", "i", "j", "up", "n", "label", "is_other", "n_words", "p0", "p1"]
    side = lambda up, own, of, met, meets: told.where("label != main" if up else "true").select(
        "*", F.pmod(F.xxhash64("n", F.lit(own)), of).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(meets) - 1)).alias(met),
        F.lit(up).alias("up"), (F.col("label") != F.col("main")).alias("is_other")).select(columns)

    def run(rows: pa.Table) -> pa.Table:
        get = {c: rows.column(c).to_numpy() for c in columns[3:]}
        up = {c: v[get["up"]] for c, v in get.items()}
        down = {c: v[~get["up"]] for c, v in get.items()}
        found = []
        for k in range(len(up["n"])):
            # two nodes outside the main class meet twice, and count once
            use = (down["label"] != up["label"][k]) & (~down["is_other"] | (down["n"] > up["n"][k]))
            use &= np.abs(down["n_words"] - up["n_words"][k]) <= (1 - threshold) * np.maximum(down["n_words"], up["n_words"][k]) + 1e-9
            at = np.flatnonzero(use)
            differ = sum(np.bitwise_count(down[p][at].view(np.uint64) ^ up[p][k : k + 1].view(np.uint64)).astype(int) for p in ("p0", "p1"))
            found.append((k, at[differ <= _most_bits(threshold)]))
        a = np.repeat(up["n"], [len(at) for _, at in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([down["n"][at] for _, at in found]) if found else np.zeros(0, np.int64)
        return pa.table({"n_a": np.minimum(a, b), "n_b": np.maximum(a, b)})

    both = side(True, "i", "ups", "j", "downs").unionByName(side(False, "j", "downs", "i", "ups"))
    return both.groupBy("bucket", "i", "j").applyInArrow(run, "n_a bigint, n_b bigint")


def _most_bits(threshold: float) -> float:
    """The bits in which the word profiles of similar texts can differ."""
    differ = (1 - threshold / (2 - threshold)) / 2  # a bit of a pair just at the threshold, by Jaccard similarity of its words
    return PROFILE * differ + 3.5 * (PROFILE * differ * (1 - differ)) ** 0.5


def _sifted(pairs: DataFrame, each: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose lengths and word profiles similar texts can have."""
    side = lambda end: each.select(*[F.col(c).alias(f"{c}_{end}") for c in ("n", "n_words", "p0", "p1")])
    return pairs.join(side("a"), "n_a").join(side("b"), "n_b").where(
        f"abs(n_words_a - n_words_b) <= {1 - threshold} * greatest(n_words_a, n_words_b) + 1e-9 and "
        f"bit_count(p0_a ^ p0_b) + bit_count(p1_a ^ p1_b) <= {_most_bits(threshold)}").select("n_a", "n_b").distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, node and label (class of the node) of every row."""
    rows = settled(nodes(docs))
    each = settled(rows.groupBy("node").agg(
        F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n_words", "p0", "p1", "buckets")]).withColumn("n", F.xxhash64("node")))
    shared = buckets(each)
    slim = each.select("n", "n_words", "p0", "p1")
    ends = reduce(DataFrame.union, (b.select("n") for b in shared)).distinct()
    reps = each.select("n", "node", "rep").join(ends, "n", "left_semi")
    coded = with_node(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "node", "codes").select("doc_id", "node", "codes")
    codes = settled(coded.join(reps, (coded["node"] == reps["node"]) & coded["doc_id"].eqNullSafe(reps["rep"])).select(
        reps["n"], coded["node"], "codes").dropDuplicates(["node"]))
    labels = components(settled(_verified(_sifted(led(shared), slim, threshold), codes, threshold)))
    more = settled(_verified(_sifted(unlike(shared[0], labels, slim, threshold), slim, threshold), codes, threshold))
    # what the first links joined, and the others
    labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
    return rows.select("doc_id", "node").join(labels, "node", "left").select("doc_id", "node", F.coalesce("label", "node").alias("label"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (least id of the class), class_size and kept of every row."""
    told = settled(classes(docs, threshold))
    sizes = told.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return told.join(sizes, "label").select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def without_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row, all columns, of every class: that of the least id (nulls last), ties by node."""
    told = classes(docs, threshold)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
    chosen = told.groupBy("label").agg(first.alias("one")).select(F.col("one.doc_id").alias("_id"), F.col("one.node").alias("_node"))
    name = free_name(docs, "_own_node")
    tagged = with_node(docs, name)
    kept = tagged.join(chosen, tagged["doc_id"].cast("bigint").eqNullSafe(chosen["_id"]) & (tagged[name] == chosen["_node"]), "left_semi")
    return kept.dropDuplicates(["doc_id", name]).drop(name)
