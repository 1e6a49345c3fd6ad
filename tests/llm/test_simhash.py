import random
import re
from itertools import combinations

import numpy as np
import xxhash

from dbgauge.llm.components import connected_components
from dbgauge.llm.simhash import _roots, fingerprint, first_of_alike, near_duplicates, near_links, op3_simhash

SCHEMA = "doc_id bigint, text string, fp string, component_id string"


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(prints):
    """Brute force: doc_id -> smallest doc_id reachable."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for at, a in enumerate(ids):
        for b in ids[at + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def plain_shingles(text):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_alike(texts):
    """Brute force over all pairs: doc_id -> smallest doc_id reachable by 3 bits or, between first texts of a fingerprint, Jaccard of at least 0.8."""
    prints = {i: plain_fingerprint(text) for i, text in texts.items()}
    root = plain_groups(prints)
    first = {}
    for i in sorted(prints):
        first.setdefault(prints[i], i)
    sets = {i: plain_shingles(texts[i]) for i in first.values()}
    for a, b in combinations(sorted(sets), 2):
        if root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return root


def test_fingerprint_by_definition():
    for text in [None, "", " \n", "One", "one two", "A b C d", "É b  c\td\x0be é", "x " * 50, "a b c d e f g " * 3000]:
        assert fingerprint(text) == plain_fingerprint(text)


def test_edges_and_clashing_columns(spark):
    rows = [(1, None, "x", "y"), (2, "", None, None), (3, "a b c", "x", "y"), (3, "a b c", "x", "y"), (None, "a b c", "x", "y"), (7, "word " * 30000, "x", "y"), (9, "other text of some words", None, None)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 3), (1, 1), (2, 1), (3, 3), (3, 3), (7, 7), (9, 9)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_random_clusters_against_brute_force(spark):
    rng = np.random.default_rng(5)
    prints = []
    for _ in range(60):
        centre = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        for _ in range(int(rng.integers(1, 60))):
            value = centre
            for bit in rng.integers(0, 64, int(rng.integers(0, 5))):
                value ^= 1 << int(bit)
            prints.append(value)
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
    want = plain_groups(dict(enumerate(prints)))
    for shard in (20, 200, 5000):
        links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in near_links(frame, shard_rows=shard).collect()]
        assert all((a ^ b).bit_count() < 64 for a, b in links)
        place = {p: i for i, p in enumerate(prints)}
        root = _roots(len(prints), np.array([place[a] for a, _ in links]), np.array([place[b] for _, b in links]))
        groups = lambda f: {tuple(sorted(i for i in range(len(prints)) if f(i) == r)) for r in {f(i) for i in range(len(prints))}}
        assert groups(lambda i: int(root[i])) == groups(lambda i: want[i])


def test_components_of_chain_star_and_loop(spark):
    links = [(i + 1, i) for i in range(40)] + [(100 + i, 99) for i in range(20)] + [(5, 5), (None, 3)] + [(-7, 300), (300, -9)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 99 for i in range(20)}, 300: -9, -7: -9}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op3_simhash(spark, sf).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in texts}


def test_alike_texts_against_brute_force(spark):
    """Texts with some words changed, cut or added; copies without an id; one text with a thousand near copies."""
    rng, texts = random.Random(3), {}
    for _ in range(40):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 200))]
        for _ in range(rng.randrange(1, 5)):
            made = list(words)
            for _ in range(rng.randrange(4)):
                made[rng.randrange(len(made))] = f"v{rng.randrange(400)}"
            texts[len(texts)] = " ".join(made[: len(made) - rng.randrange(3)])
    hot = [f"h{rng.randrange(900)}" for _ in range(120)]
    for n in range(1000):
        at = rng.randrange(100)
        texts[len(texts)] = " ".join([*hot[:at], f"x{n}", *hot[at + 1 :]])
    texts |= {2000: "", 2001: None, 2002: "one two", 2003: "one two", 2004: "one three"}
    want = plain_alike(texts)
    docs = spark.createDataFrame([(i, t, "c") for i, t in texts.items()], "doc_id bigint, text string, bands string").repartition(7)
    got = first_of_alike(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(want.values())) and {r.bands for r in got} == {"c"}
    assert len(set(want.values())) < len(set(plain_groups({i: plain_fingerprint(t) for i, t in texts.items()}).values()))
    assert first_of_alike(docs.limit(0)).count() == 0
    alone = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, None), (None, "g h i j k l"), (3, "a b c d e f")], "doc_id bigint, text string")
    assert sorted((str(r.doc_id), str(r.text)) for r in first_of_alike(alone).collect()) == [("3", "a b c d e f"), ("None", "None"), ("None", "g h i j k l")]
