"""Packing against a plain best fit, and mixing."""

import random

from evalmill.llm import mixing, packing, tokens

SIZES = "doc_id bigint, tokens bigint, shard int"


def _plain(sizes, capacity):
    """Best-fit decreasing by looking at every open container."""
    rooms, full = [], 0
    for n in sizes:
        full += n // capacity
    for n, _ in sorted(((-(n % capacity), i) for i, n in enumerate(sizes) if n % capacity)):
        fits = [(r, j) for j, r in enumerate(rooms) if r >= -n]
        if fits:
            rooms[min(fits)[1]] += n
        else:
            rooms.append(capacity + n)
    return full, sorted(rooms)


def test_tree_finds_the_tightest():
    rnd = random.Random(2)
    tree, there = packing.RoomTree(37), set()
    for _ in range(2000):
        r = rnd.randrange(38)
        if r in there:
            there.discard(r)
        else:
            there.add(r)
        tree.set(r, r in there)
        need = rnd.randrange(38)
        assert tree.tightest(need) == min((x for x in there if x >= need), default=-1)


def test_pack_is_best_fit_decreasing():
    rnd = random.Random(5)
    for capacity in (1, 7, 64):
        sizes = [rnd.choice([0, 1, capacity, rnd.randrange(3 * capacity + 1)]) for _ in range(300)]
        pieces, fill = packing.pack(sizes, capacity)
        assert [sum(n for _, n in p) for p in pieces] == sizes
        held = {}
        for p in pieces:
            for c, n in p:
                held[c] = held.get(c, 0) + n
        assert [held[c] for c in range(len(fill))] == fill and max(fill, default=0) <= capacity
        # only what is larger than a container is split
        assert all(len(p) == -(-n // capacity) for p, n in zip(pieces, sizes))
        full, rooms = _plain(sizes, capacity)
        rest = [capacity - f for i, f in enumerate(fill)]
        assert len(fill) == full + len(rooms) and sorted(r for r in rest if r) == [r for r in rooms if r]


def test_distributed_packing(spark):
    rows = [(i, n, 9) for i, n in enumerate([0, 5, 10, 3, 7, 25, 4, 4])]
    df = spark.createDataFrame(rows, SIZES)
    for shard in (3, 100):
        out = packing.packed(df.select("doc_id", "tokens"), [("k", 10), (None, 5), ("bad", 0)], shard).collect()
        assert {r["doc_id"]: sum(x["tokens"] for x in out if x["doc_id"] == r["doc_id"]) for r in out} == {i: n for i, n, _ in rows}
        assert [r["container"] for r in out if r["doc_id"] == 0] == [None]
        assert len({(r["container"]) for r in out if r["doc_id"] == 5}) == 3
    report = packing.fill_report(packing.packed(df.select("doc_id", "tokens"), [("k", 10)])).first()
    assert report["tokens"] == 58 and report["least_containers"] == 6 and report["n_containers"] == 6
    assert packing.packed(spark.createDataFrame([], SIZES).select("doc_id", "tokens"), [("k", 10)]).collect() == []
    assert packing.packed(df.select("doc_id", "tokens"), []).collect() == []


def test_mixing(spark):
    rnd = random.Random(1)
    rows = [(i, "a" if i % 3 else "b", 20 + rnd.randrange(100)) for i in range(3000)] + [(9000, None, 5), (9001, "c", 5), (9002, "a", 0)]
    texts = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.6, 3), ("none", 0.1, 5), (None, 0.5, 1), ("c", 0.0, 1)], "source_name string, target_share double, max_repeats int")
    mix = mixing.mixed(texts, targets, salts=4)
    got = mix.collect()
    assert {r["source_name"] for r in got} == {"a", "b"} and len({r["doc_id"] for r in got}) == len(got)
    limit = {"a": 2, "b": 3}
    assert all(1 <= r["copies"] <= limit[r["source_name"]] for r in got)
    share = {r["source_name"]: r for r in mixing.share_report(texts, targets, mix).collect()}
    assert abs(share["a"]["actual_share"] - 0.4) < 0.005 and abs(share["b"]["actual_share"] - 0.6) < 0.005 and share["none"]["used_tokens"] == 0
    again = mixing.mixed(texts.repartition(7), targets, salts=4)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))
    assert mixing.mixed(texts.limit(0), targets).collect() == []


def test_equal_sizes_cross_each_boundary_once(spark):
    texts = spark.createDataFrame([(i, "a", 10) for i in range(100)] + [(i, "b", 10) for i in range(100, 140)], "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source_name string, target_share double, max_repeats int")
    used = {s: sum(r["copies"] for r in mixing.mixed(texts, targets, salts=2).collect() if r["source_name"] == s) for s in "ab"}
    assert used == {"a": 40, "b": 40}


def test_both_forms_of_a_vocabulary_count_alike():
    texts = ["", "a b  c", "It's 12,345 naïve 漢字 😀\n\n\t x", "<|endoftext|> is text", "word " * 500, "z" * 5000]
    ranks, whole = (tokens.counter(f"/opt/tokenizers/byte_bpe_50k.{end}") for end in ("tiktoken", "json"))
    assert ranks(texts) == whole(texts) and ranks([""]) == [0]
