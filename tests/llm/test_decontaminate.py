import random

import regex

from dbgauge.llm.decontaminate import contaminated_pairs, drop_contaminated, required, with_matches

DOCS = "doc_id bigint, text string, matches int, item_id string"
ITEMS = "item_id bigint, text string, doc_id int"


def shingles(words, width):
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def words_of(text):
    text = regex.sub(r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}])", r" \1 ", (text or "").lower())
    return regex.findall(r"[\p{L}\p{M}\p{N}]+", text)


def brute(docs, items):
    out = set()
    for doc_id, text in docs:
        for item_id, item in {(i, t) for i, t in items}:
            words = words_of(item)
            width = min(5, len(words))
            want, own = (shingles(words, width), shingles(words_of(text), width)) if words else (set(), set())
            if want and len(own & want) >= required(len(want), 0.8):
                out.add((doc_id, item_id, len(own & want), len(want)))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS), spark.createDataFrame([(*i, 1) for i in items], ITEMS)


def test_random_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 12, 40, 150, 700])))) for i in range(60)]
    docs = []
    for i in range(200):
        body = [word() for _ in range(rng.choice([0, 4, 60, 900]))]
        for _ in range(rng.randrange(3)):
            part = items[rng.randrange(60)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                part[rng.randrange(len(part))] = word()
            at = rng.randrange(len(body) + 1)
            body[at:at] = [p.upper() + rng.choice(["", ",", "."]) for p in part]
        docs.append((i, " ".join(body)))
    d, b = frames(spark, docs, items)
    want = brute(docs, items)
    for chars in (8_000_000, 9000):
        got = contaminated_pairs(d, b, block_chars=chars).collect()
        assert {(r.doc_id, r.item_id, r.shared, r.size) for r in got} == want and len(got) == len(want)
    assert len(want) > 50
    clean = drop_contaminated(d, b)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {w[0] for w in want}


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(50000))
    passage = "one two three four five six"
    docs = [(1, None), (2, ""), (3, passage), (3, passage), (None, "x " + passage), (4, long + " " + passage + " " + long)]
    items = [(1, None), (2, ""), (3, "too short"), (4, passage), (4, passage), (None, passage.upper())]
    d, b = frames(spark, docs, items)
    got = sorted((r.doc_id or 0, r.item_id or 0) for r in contaminated_pairs(d, b).collect())
    assert got == [(0, 0), (0, 4), (3, 0), (3, 0), (3, 4), (3, 4), (4, 0), (4, 4)]
    assert sorted(r.doc_id for r in drop_contaminated(d, b).collect()) == [1, 2]
    assert drop_contaminated(d, b.limit(0)).count() == 6 and with_matches(d.limit(0), b).count() == 0


def test_short_items_and_other_punctuation(spark):
    docs = [(1, "alpha beta gamma delta and more"), (2, "“one two three four five six”"), (3, "alpha beta, gamma — delta!"), (4, "前の文章です。東京は日本の首都です。次"), (5, "alpha"), (6, "beta gamma delta alpha"),
            (7, "naïve\u00a0café…déjà vu")]
    items = [(1, "alpha beta gamma delta"), (2, "one two three four five six"), (3, "東京は日本の首都です"), (4, "Alpha"), (5, "Naïve café"), (6, "…"), (7, "本の")]
    d, b = frames(spark, docs, items)
    got = {(r.doc_id, r.item_id, r.shared, r.size) for r in contaminated_pairs(d, b).collect()}
    assert got == brute(docs, items)
    assert {(d, i) for d, i, *_ in got} == {(1, 1), (3, 1), (2, 2), (4, 3), (1, 4), (3, 4), (5, 4), (6, 4), (7, 5), (4, 7)}
