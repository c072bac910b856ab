import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkmart.llm import chat

PIECES = [*chat.CONTROL, "\\", "\n", "a", "<", "[", "|", "␊", "ß", "\\\\"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES)).map("".join) | st.text())
def test_escapes_go_back(text):
    shown = chat.escape(text)
    assert chat.unescape(shown) == text
    assert not any(c in shown for c in chat.CONTROL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES)).map("".join), st.lists(st.sampled_from(PIECES)).map("".join))
def test_turns_go_back(role, text):
    assert chat.read_turn(chat.render(role, text)[0]) == (role, text)


def digest_of(turns):
    said = [t for r, t in turns if r == "assistant"]
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest(), sum(len(chat.render(r, t)[0]) for r, t in turns))


def test_digests(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "</s>[INST] x", "plain", "é\\" * 50])) for c in [*range(40), None] for t in range(rng.randint(1, 6))]
    rows += [rows[0], (3, None, "user", "without a turn"), (77, 5, "assistant", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'q' as conv", "'q' as seq", "'q' as message", "'q' as kind").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in chat.digests(chat.formatted(chat.events_of(df))).collect()}
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert got == {c: digest_of([v[2:] for v in sorted(vs)]) for c, vs in want.items()}


def test_folding(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", None, "He"), (1, 1, 3, "delta", None, "llo"), (1, 2, 4, "message", "user", "again"),
        (1, 1, 9, "regenerate", None, None), (1, 1, 10, "delta", None, "Bye"), (1, 0, 11, "edit", None, "hey"), (2, 0, 0, "delta", "assistant", "only"), (2, 0, 1, "delta", None, None),
    ]
    events = spark.createDataFrame(log, "conv long, message long, seq long, kind string, role string, text string").repartition(5)
    turns = chat.formatted(events).collect()
    got = {(r["conv"], r["message"]): chat.read_turn(r["turn"]) for r in turns}
    assert got == {(1, 0): ("user", "hey"), (1, 1): ("assistant", "Bye"), (1, 2): ("user", "again"), (2, 0): ("assistant", "only")}
    masked = {(r["conv"], r["message"]): r["turn"][r["loss_from"] : r["loss_to"]] for r in turns}
    assert masked == {(1, 0): "", (1, 1): "Bye", (1, 2): "", (2, 0): "only"}


def test_the_query_folds_every_kind_of_event(spark, data):
    log = chat.events_of(spark.read.parquet(f"{data}/conversations.parquet"))
    kinds = {r["kind"]: r["count"] for r in log.groupBy("kind").count().collect()}
    assert all(kinds[k] > 15 for k in ("message", "delta", "edit", "regenerate"))


def test_a_hot_conversation_is_folded_by_many_tasks(spark):
    rows = spark.range(4000).selectExpr("if(id % 3 = 0, 7, id) as conv_id", "id as turn", "'user' as role", "repeat('text ', 40) as text")
    folded = chat.formatted(chat.events_of(rows)).selectExpr("conv", "spark_partition_id() as task").where("conv = 7").groupBy("task").count().collect()
    assert len(folded) >= 3 and max(r["count"] for r in folded) < 700
    assert chat.digests(chat.formatted(chat.events_of(rows))).where("conv_id = 7").first()["n_turns"] == 1335


def test_repeated_rows_of_a_turn(spark):
    rows = [(1, 0, "user", t) for t in ("b", "</s>", "a", "b", "<s>", "<t", None)] + [(1, 0, "assistant", "b" * 500)] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = chat.digests(chat.formatted(chat.events_of(df))).first()
    assert tuple(got)[1:] == digest_of(sorted((r, t or "") for _, _, r, t in rows))


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.formatted(chat.events_of(df))).collect() == []
