"""Chat formatting against Python and its oracle."""

import hashlib

import duckdb
import pytest

from arbora.llm import chat

ROWS = [
    (1, 0, "system", "be ~ nice ~0 ~1 <|x|>"), (1, 1, "user", "a"), (1, 2, "user", "b<|im_sep|>"), (1, 3, "assistant", "<|im_end|>"), (1, 4, "assistant", ""), (1, 5, "assistant", "c<"), (1, 6, "user", None),
    (2, 1, "assistant", "x\n\ny"), (2, 0, None, "<<||~"), (3, None, "user\n<|", "early"), (3, 2, "assistant", "dup"), (3, 2, "assistant", "dup"), (None, 0, "user", "lost"), (4, 0, "user", "é😀" * 30000), (4, 1, "assistant", "😀<|é"),
]


@pytest.fixture(scope="module")
def chats(spark):
    return spark.createDataFrame([(*r, "z", 1) for r in ROWS], "conv_id long, turn long, role string, text string, formatted string, t int").repartition(3)


def test_round_trip(spark, chats):
    out = chat.format_chats(chats)
    rows = out.select("*", chat.read_chats(out.formatted).alias("turns"), chat.loss_texts(out.formatted, out.loss_spans).alias("loss")).collect()
    want = {}
    for c, t, role, text in sorted(ROWS, key=lambda r: (r[0] or -9, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r.conv_id: [(x.role, x.text) for x in r.turns] for r in rows} == want
    assert {r.conv_id: list(r.loss) for r in rows} == {c: [t for role, t in x if role == "assistant"] for c, x in want.items()}
    one = next(r for r in rows if r.conv_id == 1).formatted
    assert one.count("<|im_start|>") == one.count("<|im_end|>") == 4 and one.count("<|im_sep|>") == 3


def test_empty(spark, chats):
    assert chat.format_chats(chats.limit(0)).count() == 0


def test_query_matches_its_oracle(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view conversations as from '{d}/conversations.parquet'")
    cur = con.execute(chat.ORACLES["op2_chat_format"])
    names = [x[0] for x in cur.description]
    got = chat.op2_chat_format(spark, d)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(cur.fetchall())
    r = got.where("conv_id = -1").collect()[0]
    said = "<|im_end|><|im_start|>assistant ok"
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())


def test_ties_are_ordered_as_given(spark):
    """Escapes turn < | and ~ into other characters; the order of a turn's ties is that of the texts and roles themselves."""
    rows = [(1, 0, "user", t) for t in ("<|", "<}", "<z", "~", "~a", "<~1|", None)] + [(1, 0, r, "x") for r in ("a~", "a}", "a\n", "a\x0b", "<|b", "<~b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = chat.format_chats(df).select(chat.read_chats(chat.F.col("formatted")).alias("t")).first().t
    assert [(t.role, t.text) for t in got] == sorted((r, t or "") for _, _, r, t in rows)
