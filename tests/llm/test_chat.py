import hashlib
import random
import re

import pytest

from dbgauge.llm import chat
from dbgauge.llm.chat import CONTROLS, Renderer, chat_template, digest_conversations, escape, format_conversations, format_pieces, format_prefixes, op7_chat, read_back, render, unescape

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted int, n_turns string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_round_trip_of_hostile_texts():
    rng = random.Random(2)
    parts = [*CONTROLS, "\\", "\\\\", "\n", "<", "|im_end|>", "<\\|im_end|>", "<<", "[", "/INST]", "x", "é", "user"]
    for _ in range(3000):
        turns = [("".join(rng.choices(parts, k=rng.randrange(3))), "".join(rng.choices(parts, k=rng.randrange(9)))) for _ in range(rng.randrange(4))]
        output = chat_template(turns)
        assert read_back(output) == turns
        assert all(unescape(escape(t)) == t and not any(c in escape(t) for c in CONTROLS) for _, t in turns)
        made = render(turns)
        assert made.rewritten_at is None and [unescape(output[a:b]) for a, b in made.contents] == [t for _, t in turns]
        assert "".join(output[a:b] for a, b in made.spans) == output
    with pytest.raises(ValueError):
        read_back("<|im_start|>user\nx")


def test_black_box_templates():
    turns = [("system", "s"), ("user", "u"), ("assistant", "X"), ("user", "Y"), ("assistant", "bb")]
    other = lambda ts: "<s>" + "".join(f"({r}) {t} /end/" for r, t in ts)
    made = render(turns, other)
    assert made.rewritten_at is None and [made.output[a:b] for a, b in made.contents] == ["s", "u", "X", "Y", "bb"]
    assert render(turns, lambda ts: f"{len(ts)} turns" + other(ts)).rewritten_at == 0 + 1
    assert render(turns, lambda ts: "".join(t for _, t in ts[-2:])).rewritten_at == 2
    assert render(turns, lambda ts: "".join(f"[{t}]" for r, t in ts if r != "system")).rewritten_at == 0


def test_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, None, ""), (2, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, None, "system", "first"), (None, 0, "assistant", "x\n"), (3, 0, "assistant", "long " * 200000)]
    got = {r.conv_id: r for r in format_conversations(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()}
    want = {1: [("", ""), ("user", "")], 2: [("system", "first"), ("user", "a"), ("assistant", "b"), ("assistant", "b")], None: [("assistant", "x\n")], 3: [("assistant", "long " * 200000)]}
    want[1] = [("user", ""), ("", "")]
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == {k: expected(t) for k, t in want.items()}
    assert [r.formatted[s.start : s.end] for r in [got[2]] for s in r.loss_spans] == ["b", "b"]
    assert format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = format_conversations(spark.createDataFrame([(*r, 1, "x") for r in rows[2:4]], SCHEMA), lambda ts: "".join(t for _, t in reversed(ts)), lambda out: [("user", out)]).first()
    assert odd.rewritten_at == 1 and odd.loss_chars == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    convs = {}
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    convs[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op7_chat(spark, sf).collect()}
    assert got == {k: expected(t) for k, t in convs.items()}


def digests(spark, rows, template=chat_template, parse=read_back):
    made = digest_conversations(format_pieces(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, seq int"), template, parse, piece_chars=300).persist(), parse)
    return {r.conv_id: tuple(r)[1:] for r in made.collect()}


@pytest.fixture
def parted(spark):
    """Small ranges stay tasks of their own."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pieces_over_many_tasks(parted):
    """A conversation that holds most rows, cut by tasks and pieces, equals whole rendering; templates with a start mark too."""
    spark = parted
    rng = random.Random(5)
    turns = {None: 700, 7: 90, 8: 2, 9: 1, 10: 40}
    convs = {c: [(rng.choice(["user", "assistant", ""]), "".join(rng.choices(["\\", "</s>", "x\n", "é"], k=rng.randrange(9)))) for _ in range(n)] for c, n in turns.items()}
    rows = [(c, t, *turn, 0) for c, ts in convs.items() for t, turn in enumerate(ts)]
    rng.shuffle(rows)
    begun = lambda ts: "".join(["<s>", chat_template(ts)])
    for template, parse in ((chat_template, read_back), (begun, lambda out: read_back(out.removeprefix("<s>")))):
        want = {c: (*expected(ts), len(template(ts)), None) for c, ts in convs.items()}
        assert digests(spark, rows, template, parse) == want
    pieces = format_pieces(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, seq int"), piece_chars=300)
    hot = pieces.where("conv_id is null").collect()
    assert len({r.seq >> 40 for r in hot}) > 1 and max(len(r.formatted) for r in hot) < 300 + 200
    assert digests(spark, []) == {}


def test_long_conversation_is_linear(spark):
    turns = [("user", "word " * 40)] * 6400
    calls = []
    counted = lambda ts: calls.append(len(ts)) or chat_template(ts)
    renderer = Renderer(counted)
    assert all(renderer.add(*turn) for turn in turns) and sum(calls) < 8 * len(turns)


def test_bounded_prefixes_tell_rewriting(spark):
    rows = [(1, t, "user", str(t), 0) for t in range(30)]
    forget = lambda ts: "".join(t for _, t in ts[-2:])
    counts = lambda ts: "".join(f"{n} {chat_template([t])}" for n, t in enumerate(ts))
    for template in (forget, counts, lambda ts: chat_template(ts[::-1])):
        (got,) = digests(spark, rows, template).values()
        assert got[:5] == (None,) * 5 and 0 <= got[5] <= chat.WINDOW


def test_prefixes_from_the_first_turn(parted):
    """Templates that look at all turns before, and one that rewrites history at its twelfth turn, which prefixes of a window never show."""
    spark = parted
    rng = random.Random(7)
    convs = {c: [(rng.choice(["user", "assistant"]), "".join(rng.choices(["\\", "</s>", "x\n", "é"], k=rng.randrange(9)))) for _ in range(n)] for c, n in ((None, 14), (1, 30), (2, 8), (3, 1), (4, 11), (5, 12))}
    rows = [(c, t, *turn, 0) for c, ts in convs.items() for t, turn in enumerate(ts)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, seq int")

    def got(template, parse, **bounds):
        made = digest_conversations(format_prefixes(frame, template, parse, **bounds).persist(), parse)
        return {r.conv_id: tuple(r)[1:] for r in made.collect()}

    want = {c: (*expected(ts), len(chat_template(ts)), None) for c, ts in convs.items()}
    assert got(chat_template, read_back) == want
    assert got(chat_template, read_back, work=900) == want  # some are beyond, and dealt as pieces
    assert got(chat_template, read_back, chars=0, piece_chars=50) == want
    empty = format_prefixes(frame.limit(0).withColumnRenamed("seq", "long"))
    assert digest_conversations(empty.persist()).count() == 0

    counts = lambda ts: "".join(f"{n}\n{chat_template([t])}" for n, t in enumerate(ts))
    parse = lambda out: read_back(re.sub(r"(^|(?<=<\|im_end\|>\n))[0-9]+\n", "", out))
    assert got(counts, parse) == {c: (*expected(ts), len(counts(ts)), None) for c, ts in convs.items()}

    drops = lambda ts: chat_template(ts if len(ts) < 12 else ts[1:])
    assert got(drops, read_back) == {c: want[c] if len(ts) < 12 else (None,) * 5 + (11,) for c, ts in convs.items()}


def test_query_renders_prefixes_from_the_first_turn(spark, tmp_path, monkeypatch):
    rows = [(1, t, "user" if t % 2 else "assistant", f"text {t}") for t in range(20)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    drops = lambda ts: chat_template(ts if len(ts) < 12 else ts[1:])
    for name in ("format_pieces", "format_prefixes"):
        monkeypatch.setattr(chat, name, lambda frame, f=getattr(chat, name), **more: f(frame, drops, **more))
    assert {r.conv_id: r.rewritten_at for r in op7_chat(spark, str(tmp_path)).collect()} == {-1: None, 1: 11}


def test_long_conversations_are_rendered_from_the_first_turn(parted):
    """Beyond the bounds too: many tasks, each prefix from its first turn, and outputs that can only be read as a whole; keys may be missing, rows may repeat."""
    spark = parted
    rng = random.Random(11)
    convs = {c: [(rng.choice(["user", "assistant"]), "".join(rng.choices(["\\", "</s>", "x\n", "é"], k=rng.randrange(9)))) for _ in range(n)] for c, n in ((None, 90), (1, 30), (2, 8), (3, 1), (4, 11))}
    convs[1][5:7] = [("user", "same")] * 2
    rows = [(c, t, *turn) for c, ts in convs.items() for t, turn in enumerate(ts)]
    rows = [(c, 5 if (c, t) == (1, 6) else t, role, text) for c, t, role, text in rows]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")

    def got(template, parse, **bounds):
        pieces = format_prefixes(frame, template, parse, **bounds).persist()
        return pieces, {r.conv_id: tuple(r)[1:] for r in digest_conversations(pieces, parse).collect()}

    counts = lambda ts: "<s>" + "".join(f"{n}\n{chat_template([t])}" for n, t in enumerate(ts))

    def whole(out):
        assert out.startswith("<s>0\n")
        return read_back(re.sub(r"(^|(?<=<\|im_end\|>\n))[0-9]+\n", "", out[3:]))

    drops = lambda ts: chat_template(ts if len(ts) < 12 else ts[1:])
    late = lambda ts: chat_template(ts if len(ts) < 80 else ts[1:])
    plain = {c: (*expected(ts), len(chat_template(ts)), None) for c, ts in convs.items()}
    for bounds in ({"work": 900}, {"chars": 0, "work": 300, "piece_chars": 50}):
        pieces, found = got(counts, whole, **bounds)
        assert found == {c: (*expected(ts), len(counts(ts)), None) for c, ts in convs.items()}
        hot = pieces.where("conv_id is null").collect()
        assert len({r.seq >> 40 for r in hot}) > 3 and sum(r.piece_turns for r in hot) == 90
        assert got(drops, read_back, **bounds)[1] == {c: plain[c] if len(ts) < 12 else (None,) * 5 + (11,) for c, ts in convs.items()}
        assert got(late, read_back, **bounds)[1] == {c: plain[c] if len(ts) < 80 else (None,) * 5 + (79,) for c, ts in convs.items()}


def test_prefixes_rendered_are_all(spark, tmp_path):
    """Each turn of a long conversation is rendered behind all turns before it, and with both probes."""
    turns = [("user", f"text {t:02d}") for t in range(40)]
    frame = spark.createDataFrame([(1, t, *turn) for t, turn in enumerate(turns)], "conv_id bigint, turn bigint, role string, text string")
    log = tmp_path / "calls"
    log.mkdir()

    def logged(ts):
        (log / f"{len(ts)}-{ts[-1][1] if ts else ''}-{hashlib.sha256(repr(ts[:-1]).encode()).hexdigest()}").touch()
        return chat_template(ts)

    assert digest_conversations(format_prefixes(frame, logged, work=1000).persist()).first().n_turns == 40
    want = {f"{n + 1}-{last}-{sha(repr(turns[:n]))}" for n in range(40) for last in ("X", "Y", turns[n][1])}
    assert {p.name for p in log.iterdir()} >= want
