"""Results against brute force and hand-made cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docplan.llm import decontamination, host_rules, licenses, near_copies, packing, quality, quotations, sharding, suffix_tree, toxicity
from tests.llm.conftest import filler

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_windows_hold_every_copy_and_close_copy(make, spark):
    items = [(k, filler(1000 + k, n)) for k, n in enumerate((5, 9, 12, 30, 60, 90, 400))] + [(90, None), (91, "too few")]
    texts = [filler(k, 200) for k in range(12)]
    for k, (_, item) in enumerate(items[:7]):
        texts.append(filler(50 + k, 33 + k) + "\n" + item.upper() + ". " + filler(70 + k, 20))
    changed = items[5][1].split()
    changed[40] = "other"
    texts.append(filler(80, 21) + " " + " ".join(changed))
    texts.append(" ".join(items[5][1].split()[:40]))  # less than half an item
    bench = spark.createDataFrame(items, "item_id int, text string")
    docs = make(texts)
    found = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(docs, bench).collect()}
    assert set(found) == {(12 + k, k) for k in range(7)} | {(19, 5)}
    assert all(found[12 + k, k]["similarity"] == 1 and found[12 + k, k]["first_word"] == 33 + k for k in range(7))
    assert 0.8 <= found[19, 5]["similarity"] < 1
    clean = decontamination.without_contaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [*range(12), 20]


def test_shortened_and_altered_copies_equal_brute_force(make, spark):
    """Rows that are items cut short, at a row's end or alone, and copies with other words: all windows from 0.8 on."""
    rng = random.Random(8)
    items = [filler(3000 + k, n).split() for k, n in enumerate((12, 40, 100, 100, 250))]
    texts = [" ".join(items[2][:90]), " ".join(items[2][10:]), " ".join(items[3][5:95]), filler(1, 50) + " " + " ".join(items[3][:90])]
    for k in range(250):
        own = items[k % 5].copy()
        for _ in range(rng.randrange(2 + len(own) // 50)):
            own[rng.randrange(len(own))] = f"new{k}"
        texts.append(f"{filler(k, rng.randrange(9))} {' '.join(own[rng.randrange(4) :])} {filler(k + 500, rng.randrange(9))}")

    def bag(words):
        return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))

    def weight(counts):
        return sum(n * sum(map(len, s)) for s, n in counts.items())

    want = {}
    for k, text in enumerate(texts):
        words = text.split()
        for j, item in enumerate(items):
            goal, n = bag(item), len(item) - 4
            if not goal & bag(words):
                continue
            for p in range(1 - n, len(words) - 4):
                own = bag(words[max(p, 0) : max(0, min(len(words), p + n + 4))])
                share = weight(goal & own) / weight(goal | own)
                if share >= 0.8:
                    want[k, j] = max(share, want.get((k, j), 0))
    bench = spark.createDataFrame([(j, " ".join(i)) for j, i in enumerate(items)], "item_id int, text string")
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.contaminated(make(texts), bench).collect()}
    assert {(0, 2), (1, 2), (2, 3), (3, 3)} < set(want) and 60 < len(want) < 250
    assert found == pytest.approx(want)


def test_all_fingerprints_within_the_radius_are_found():
    rng = np.random.default_rng(3)
    index = decontamination.Index([(k, filler(k, 41)) for k in range(6)])
    (size, (own, *_)), = index.tables().items()
    prints = np.concatenate([rng.integers(0, 1 << 63, 4000, dtype=np.uint64), own])
    for k in range(4000):
        for bit in rng.choice(64, rng.integers(0, 20), replace=False):
            prints[k] = own[k % len(own)] ^ np.uint64(1 << int(bit)) if bit % 5 == 0 else prints[k]
    near = set(zip(*(x.tolist() for x in index.near(prints, size))))
    assert near == {(i, j) for i, p in enumerate(prints) for j, q in enumerate(own) if bin(int(p) ^ int(q)).count("1") <= index.radius}


def _judged(frame, truth):
    rows = [r for r in frame.collect() if r["held_out"]]
    return sum(r["predicted"] == truth[r["doc_id"]] for r in rows) / len(rows)


def test_additive_model_tells_junk(make, spark):
    texts = [filler(k, 60 + k % 50) if k % 3 else " ".join([filler(k, 3) + " ***"] * (20 + k % 9)) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(400)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    out = quality.rate(make(texts), labels)
    assert _judged(out, {k: int(k % 3 > 0) for k in range(400)}) > 0.97
    assert {r["doc_id"] for r in out.where("held_out").collect()} == {k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2}
    assert quality.without_junk(make(texts), labels).where("doc_id % 3 = 0").count() < 5


def test_machine_tells_insults_with_gaps(make, spark):
    rng, insults = random.Random(1), ["gropfel", "narrzut", "dolkrak"]
    texts = []
    for k in range(600):
        own = filler(k, 40).split()
        if k % 4 == 0:
            own.insert(rng.randrange(40), insults[k // 4 % 3])
        texts.append(" ".join(own))
    texts += [filler(900, 30) + " grop-fel " + filler(901, 9), filler(902, 30) + " n a r r z u t", filler(903, 30) + " dolkxrak", filler(904, 40)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(600)], "doc_id bigint, toxic int")
    out = toxicity.rate(make(texts), labels)
    assert _judged(out.where("doc_id < 600"), {k: int(k % 4 == 0) for k in range(600)}) > 0.98
    assert [r["predicted"] for r in out.where("doc_id >= 600").orderBy("doc_id").collect()] == [1, 1, 1, 0]
    assert toxicity.without_toxic(make(texts), labels).where("doc_id < 600 and doc_id % 4 = 0").count() <= 3


def test_folded_table_equals_the_kernel():
    codes, weights = toxicity.occurrences(toxicity._matrix_of([bytes([2, 3, 4, 5]), bytes([2, 9, 3, 4, 5]), bytes([7, 8, 9])]))
    sums = [Counter() for _ in codes]
    for s, row in zip(sums, codes):
        for c, w in zip(row, weights):
            s[int(c)] += w * (c > 0)
    norms = [sum(v * v for v in s.values()) for s in sums]
    assert np.allclose(toxicity.squared_norms(codes, weights), norms)
    alike = sum(sums[0][c] * sums[1][c] for c in sums[0]) / (norms[0] * norms[1]) ** 0.5
    assert 0.5 < alike < 1 and sum(sums[0][c] * sums[2][c] for c in sums[0]) == 0


def test_distinct_strings_are_told_apart():
    texts = [bytes([2 + (k >> j & 1) for j in range(20)]) for k in range(1 << 10)]
    flat = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    assert len(toxicity.distinct(flat, ends - 20, ends)[0]) == len(texts)


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_banded_alignment_equals_the_full_one():
    rng = np.random.default_rng(0)
    for t in range(200):
        a = rng.integers(0, 3, rng.integers(0, 25)).astype(np.uint32)
        b = np.delete(a, rng.integers(0, len(a), 2)) if t % 2 and len(a) > 3 else rng.integers(0, 3, rng.integers(0, 25)).astype(np.uint32)
        want = _edits(a.tolist(), b.tolist())
        for limit in (0, 2, 5, 30):
            assert near_copies.edit_distance(a, b, limit) == min(want, limit + 1)


def test_classes_equal_brute_force(make):
    rng = random.Random(5)
    texts = []
    for family in range(12):
        base = filler(family * 17, 60 + family * 9).split()
        for _ in range(1 + family % 4):
            own = base.copy()
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(999)}"
            texts.append(" ".join(own))
    hot = filler(999, 100).split()
    texts += [" ".join(hot[:k % 90] + [f"v{k}"] + hot[k % 90:]) for k in range(120)] + [" ".join(hot)] * 40
    passage = filler(555, 30)
    texts += [passage + " " + filler(2000 + k, 60) for k in range(60)] + ["a b", "a b", "a  B", "a c", "", ""]
    words = [tuple(re.findall(r"[a-z0-9]+", t.lower())) for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if top(i) != top(j):
                a, b = words[i], words[j]
                longer = max(len(a), len(b))
                few = longer and min(len(a), len(b)) < 5
                if a == b or (not few and abs(len(a) - len(b)) <= 0.2 * longer and len(set(a) & set(b)) > 0.5 * longer and _edits(a, b) <= 0.2 * longer):
                    up[max(top(i), top(j))] = min(top(i), top(j))
    found = {r["doc_id"]: r for r in near_copies.deduplicated(make(texts)).collect()}
    assert [found[k]["class_id"] for k in range(len(texts))] == [top(k) for k in range(len(texts))]
    kept = near_copies.without_near_copies(make(texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({top(k) for k in range(len(texts))})


def test_stars_and_chains_in_one_bucket(make, monkeypatch):
    """Members of a leader's class still meet the rest of their bucket: links that lead through them count."""
    nodes = near_copies.nodes
    monkeypatch.setattr(near_copies, "nodes", lambda docs: nodes(docs).selectExpr(
        "doc_id", "node", "n_words", "p0", "p1", "array(named_struct('b0', 1L, 'b1', 1L, 'b2', 1L)) as buckets"))
    texts = []
    for family in range(12):
        words = filler(family * 31, 60).split()
        for k in range(5):  # a chain of blocks replaced one after the other, or a star of blocks replaced in the base
            own = words if family % 2 else words.copy()
            own[k * 10 : k * 10 + 10] = [f"f{family}k{k}n{i}" for i in range(10)] if k else own[:10]
            texts.append(" ".join(own))
    split = [t.split() for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and i // 5 == j // 5 and _edits(split[i], split[j]) <= 12:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    found = {r["doc_id"]: r["class_id"] for r in near_copies.deduplicated(make(texts)).collect()}
    assert [found[k] for k in range(len(texts))] == label == [k // 5 * 5 for k in range(len(texts))]


@pytest.mark.parametrize("n, changed", [(300, 60), (300, 30), (60, 12), (20, 4), (12, 2), (9, 1), (5, 1)])
def test_recall_by_edit_similarity(make, n, changed):
    """Pairs of random words with random substitutions, down to the threshold itself: at least nine in ten are joined."""
    rng = random.Random(n + changed)
    texts = []
    for k in range(100):
        words = [f"q{rng.randrange(50000)}" for _ in range(n)]
        other = words.copy()
        for at in rng.sample(range(n), changed):
            other[at] = f"z{rng.randrange(50000)}"
        texts += [" ".join(words), " ".join(other)]
    found = {r["doc_id"]: r["class_id"] for r in near_copies.deduplicated(make(texts)).collect()}
    assert sum(found[2 * k] == found[2 * k + 1] for k in range(100)) >= (100 if n < near_copies.SHORT else 90)


def test_order_matters_to_sketches():
    a, b = np.arange(1, 9, dtype=np.uint64), np.arange(8, 0, -1).astype(np.uint64)
    few = np.arange(1, 4, dtype=np.uint64)
    assert (near_copies.order_min_hash(few, few) != near_copies.order_min_hash(few[::-1].copy(), few[::-1].copy())).all()
    assert not (near_copies.order_min_hash(a, a) == near_copies.order_min_hash(b, b)).any()


def test_copies_that_share_only_crowded_buckets(make):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = [word() for _ in range(120)]
    texts = []
    for _ in range(150):
        own = [word() for _ in range(80)]
        # every second word of the own part differs: no three of them in a row are shared
        texts += [" ".join(passage + own), " ".join(passage + [w if k % 2 else word() for k, w in enumerate(own)])]
    found = {r["doc_id"]: r["class_id"] for r in near_copies.deduplicated(make(texts)).collect()}
    joined = sum(found[2 * k] == found[2 * k + 1] == 2 * k for k in range(150))
    assert joined >= 145  # a pair shares some bucket with probability 0.99


def test_suffix_tree_scores(make, spark):
    texts = [" ".join(["The", "cat", "sat"][(k + i * i) % 3] for i in range(30 + k % 7)) for k in range(300)] + ["Zyzzyva QUÉ", "", None]
    docs = make(texts)
    out = {r["doc_id"]: r for r in suffix_tree.scores(docs).collect()}
    tokens = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + [None] for t in texts]
    counts = Counter(w for k, own in enumerate(tokens) if zlib.crc32(str(k).encode()) % 10 for w in own)
    n, v = sum(counts.values()), len(counts)
    for k, own in enumerate(tokens):
        r = out[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in counts for w in own), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 10 == 0) and r["score"] <= 0
    held = [r for r in out.values() if r["held_out"] and r["doc_id"] < 300]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_suffix_tree_is_a_distribution(make):
    docs = make([filler(k, 200) for k in range(20)])
    tree = suffix_tree.learn(docs, suffix_tree.word_and_byte_counts(docs))
    for rows in tree.rows:
        assert np.allclose((10.0 ** rows).sum(axis=1), 1, atol=1e-4)
    assert (10.0 ** tree.rest[tree.symbol == 63]).sum() == pytest.approx(1)
    # a place's state is the longest counted context before it
    line = np.array([0] * 5 + tree.symbol[list(b"w12x3")].tolist() + [1, 0], np.uint8)
    for length, state in enumerate(tree.states(line), 2):
        codes = np.arange(64**2) if length == 2 else tree.codes[length - 3]
        for i in range(5, len(line)):
            code = int("".join(f"{int(s):02d}" for s in []) or 0)
            for s in line[i - length : i]:
                code = code * 64 + int(s)
            at = np.searchsorted(codes, code)
            assert state[i] == (at if at < len(codes) and codes[at] == code else len(codes))


def test_quotes_rebuild_threads(spark):
    first, second = "Shall we meet at noon in the hall?\nBring the long list of names.", "Noon is fine with me, see you."
    rows = [
        (10, 1, first), (11, 2, "ann wrote:\n> " + first.replace("\n", "\n> ") + "\n" + second),
        (12, 3, f"bob wrote:\n> ann wrote:\n>> {first.splitlines()[0]}\n> {second}\n\nGood."),
        (13, 4, "> Bring  the long LIST of names\nI have it."), (14, 5, "On its own."), (15, 6, None), (16, 7, "> never said by anyone here at all\nWhat?"),
        (14, 5, "On its own."),
    ]
    out = {r["message"]: r for r in quotations.linked(spark.createDataFrame(rows, "message int, sent int, body string")).collect()}
    assert {k: (r["parent"], r["conversation"], r["depth"]) for k, r in out.items()} == {
        10: (None, 10, 0), 11: (10, 10, 1), 12: (11, 10, 2), 13: (10, 10, 1), 14: (None, 14, 0), 15: (None, 15, 0), 16: (None, 16, 0)}
    assert out[11]["own_text"] == second and out[12]["own_text"] == "Good." and out[13]["own_text"] == "I have it."


def test_long_chain_of_replies(spark):
    rows = [(k, k, (f"> text number {k - 1} of the long chain\n" if k else "") + f"text number {k} of the long chain") for k in range(300)]
    out = quotations.in_reply_order(quotations.linked(spark.createDataFrame(rows, "message int, sent int, body string")))
    assert [(r["message"], r["conversation"], r["depth"]) for r in out.orderBy("depth").collect()] == [(k, 0, k) for k in range(300)]


def test_hot_conversation_and_rows_without_ids(spark):
    """One row for each row: over 65,536 turns, null conversations and turns, repeated rows."""
    size, said = 70000, ["the first of both things said", "the second of both things said"]
    hot = spark.range(size).selectExpr("1L as conv_id", "id as turn", "'user' as role", f"if(id % 2 = 0, '{said[0]}', '{said[1]}') as text")
    rows = [(2, 0, "user", "something else was said here"), (2, 1, "user", "and then an answer was given"), (2, 1, "user", "and then an answer was given"),
            (2, None, "user", "something else was said here"), (None, 0, "user", said[0]), (None, 1, "user", said[1]), (None, None, None, None), (None, None, None, None)]
    mail = hot.unionByName(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    out = [tuple(r) for r in quotations.threads(mail).collect()]
    long = {r[1]: r for r in out if r[0] == 1}
    assert len(out) == size + len(rows) and len(long) == size
    assert all(long[k][2:5] == ((None, 0, 0) if k == 0 else (0, 0, 1) if k % 2 else (1, 0, 2)) for k in range(size))
    key = lambda r: [(v is None, v or 0) for v in r]
    assert sorted((r[:5] for r in out if r[0] == 2), key=key) == [(2, 0, None, 0, 0), (2, 1, 0, 0, 1), (2, 1, 0, 0, 1), (2, None, None, None, 0)]
    assert sorted((r[:5] for r in out if r[0] is None), key=key) == [
        (None, 0, None, 0, 0), (None, 1, None, 1, 0), (None, None, None, None, 0), (None, None, None, None, 0)]


def test_shards_are_a_computable_shuffle(make):
    docs = make([f"text {k % 90}" for k in range(1000)] + [None] * 3)
    rows = sharding.shard(docs, 16, key=7).collect()
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(docs.repartition(5), 16, key=7).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}
    assert sorted(r["row_number"] for r in rows) == list(range(1003))
    for r in rows:
        assert (r["shard"], r["slot"]) == sharding.place(r["row_number"], 1003, 7, 16)
        text = f"text {r['doc_id'] % 90}" if r["doc_id"] < 1000 else None
        assert r["size"] == len(text or "") + 1 and r["text_crc32"] == zlib.crc32((text or "").encode())
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {len(s) for s in slots.values()} == {62, 63}


@pytest.mark.parametrize("rows", [1, 2, 3, 4, 5, 7, 12, 100, 101, 2500, 4097])
def test_places_are_a_permutation(rows):
    assert sorted(slot * 5 + shard for shard, slot in (sharding.place(k, rows, 3, 5) for k in range(rows))) == list(range(rows))


def test_packing_keeps_every_id(make):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["don't we'll.", "a<|endoftext|>b <|StartOfText|> x", "É́ é  x y", "ΣΑΣ. abc…", "12345 $$$,, U.S., naïve?!", "汉字 text, ,ab", "", None]
    texts = odd + [filler(k, 30 + k * k % 1500) for k in range(60)] + [filler(7, 9000)]
    rows = packing.pack(packing.tokenized(make(texts), public_tokenizers.path("word_bpe_49k.json"), 4096)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for k, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(pieces[k], key=lambda r: r["start"]):
            raw = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(raw), len(ids))
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096


def test_best_fit_takes_the_tightest_room():
    rng = np.random.default_rng(2)
    sizes = -np.sort(-rng.integers(1, 100, 500))
    got, offsets = packing.best_fit_decreasing(sizes, 100)
    rooms: list[int] = []
    for size, number, offset in zip(sizes, got, offsets):
        fitting = [r for r in rooms if r >= size]
        if fitting:
            assert rooms[number] == min(fitting)
        else:
            assert number == len(rooms)
            rooms.append(100)
        assert offset == 100 - rooms[number]
        rooms[number] -= size


def _measures(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def test_host_rules_equal_brute_force(make, tricky):
    rng = random.Random(4)
    texts = ["\n".join(" ".join(rng.choice(["a", "bé", "c#", "汉", "d|d"]) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 30))) for _ in range(120)]
    for docs in (make(texts), tricky):
        told = {}
        for r in docs.collect():
            told.setdefault(r["doc_id"], set()).add(_measures(r["text"] or ""))
        for r in host_rules.judge(docs).collect():
            got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
            assert got in told[r["doc_id"]]
            assert r["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0])
            assert not (r["kept"] and r["base_failed"])


def test_small_hosts_are_shrunk(spark):
    rows = [("good", k % 10 == 0) for k in range(500)] + [("bad", k % 20 != 0) for k in range(400)] + [("tiny", True)] + [(None, False)] * 50
    rows += [(f"h{j}", k < j) for j in range(8) for k in range(60)]
    out = {r["host"]: r for r in host_rules.host_rates(spark.createDataFrame(rows, "host string, failed boolean")).collect()}
    assert out["bad"]["rejected"] and not out["good"]["rejected"] and not out["tiny"]["rejected"] and out["tiny"]["rate"] < 0.7


def test_licences(make):
    mit, notice = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0 notice"]
    texts = [filler(1, 90) + "\n" + notice, filler(2, 20) + "\n\n" + "\n".join(mit[i : i + 80] for i in range(0, 800, 80)) + "\n\n" + filler(3, 5),
             mit.lower().replace("software", "program", 1), filler(4, 500), notice, None, "", "licensed under"]
    out = {(r["doc_id"], r["template"]): r["dice"] for r in licenses.scan(make(texts)).collect()}
    assert out[0, "Apache-2.0 notice"] == 1 and out[4, "Apache-2.0 notice"] == 1 and out[2, "MIT"] > 0.95 and {k[0] for k in out} <= {0, 1, 2, 4}


def test_licences_across_lines_and_in_prose(make):
    """Verbatim paragraphs between prose and code, a wrapped notice followed by text, a notice in a line."""
    mit, isc, notice = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["ISC"], licenses.TEMPLATES["Apache-2.0 notice"]
    for mark in (" The above", " THE SOFTWARE IS"):
        mit, isc = mit.replace(mark, "\n\n" + mark.strip(), 1), isc.replace(mark, "\n\n" + mark.strip(), 1)
    assert mit.count("\n\n") == 2 and isc.count("\n\n") == 1
    gpl = licenses.TEMPLATES["GPL-3.0 notice"].replace(" the GNU", "\nthe GNU")
    texts = [filler(1, 90) + "\n\n" + mit + "\n\n" + filler(2, 300), filler(3, 90) + "\n" + isc + "\n" + filler(4, 90),
             filler(5, 30) + "\n" + gpl + "\n" + filler(6, 30), filler(7, 30) + " " + notice + " " + filler(8, 30),
             filler(9, 40) + " " + " ".join(mit.split()[:90]) + " " + filler(10, 200)]
    out = {(r["doc_id"], r["template"]): r for r in licenses.scan(make(texts)).collect()}
    assert {(0, "MIT"), (1, "ISC"), (2, "GPL-3.0 notice"), (3, "Apache-2.0 notice")} == set(out)
    assert all(r["dice"] == 1 and r["shared"] == r["n_bigrams"] == r["n_template"] for r in out.values())


def test_licence_windows_equal_brute_force(make):
    rng, template = random.Random(6), licenses.TEMPLATES["BSD notice"]
    own = [w.lower() for w in re.findall(r"[^\W_]+", template)]
    texts = []
    for k in range(60):
        changed = [w if rng.random() > 0.12 else rng.choice(["new", w + " " + w, ""]) for w in own]
        texts.append(filler(k, rng.randrange(12)) + " " + " ".join(changed) + " " + filler(k + 90, rng.randrange(12)))
    goal, most = set(licenses.bigrams_of(template)), int((len(own) - 1) * 1.5)
    want = {}
    for k, text in enumerate(texts):
        words = re.findall(r"[^\W_]+", text)
        grams = [f"{a} {b}" for a, b in zip(words, words[1:])]
        best = max(2 * len(goal & set(grams[i:j])) / (len(goal) + len(set(grams[i:j]))) for i in range(len(grams)) for j in range(i + 1, min(len(grams), i + most) + 1))
        whole = 2 * len(goal & set(grams)) / (len(goal) + len(set(grams)))
        if best >= 0.8:
            want[k] = max(whole, best)
    found = {r["doc_id"]: r["dice"] for r in licenses.scan(make(texts)).where("template = 'BSD notice'").collect()}
    assert found == pytest.approx(want) and 5 < len(want) < 60
