import hashlib

from cases import ODD
from pyspark.sql import functions as F

from lectern.llm import chat_format as C

TRICKY = [C.TRAP, r"<\s> <\\s> [\/INST] [/INST]</s><s>", "<", "[", "<s", "</s", r"\<s>", "[image] [audio] [/document]", "a<</s>>b[[INST]]", "\\", "$1 \\1", "<s>" * 300]


def test_round_trip_of_control_strings(spark):
    texts = ODD + TRICKY
    rows = [(i, k, role, t) for i, t in enumerate(texts) for k, role in enumerate(["system", "user", "assistant", None, "assistant", "<s>\n[INST]"])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", C.text_parts(F.col("text")).alias("parts"), F.lit(1).alias("t"), F.lit(2).alias("formatted"))
    got = C.format_chats(turns).select("conv_id", C.read_turns(F.col("formatted")).alias("turns"), C.read_loss(F.col("formatted"), F.col("loss")).alias("m")).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.conv_id] or ""
        assert [(x.role, x.text) for x in r.turns] == [(role, t) for role in ["system", "user", "assistant", "", "assistant", "<s>\n[INST]"]]
        assert r.m == t + t


def test_parts_become_placeholders(spark):
    part = lambda t, **k: {"type": t, "text": None, "ref": None, "units": None} | k
    rows = [(1, 0, "user", [part("text", text="see "), part("image", ref="a.png", units=2), part("text", text=" [image] "), part("audio", ref="b.wav", units=10)]), (1, 1, "assistant", [part("document", ref="c"), part("other", text="x")]), (1, 2, "user", None)]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{C.PART}>")
    r = C.format_chats(turns).first()
    assert r.formatted == r"<s>user[INST]see [image] [\image] [audio][/INST]</s><s>assistant[INST][document]x[/INST]</s><s>user[INST][/INST]</s>"
    assert [(a.type, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 1152), ("audio", "b.wav", 250), ("document", "c", 800)]
    assert r.n_tokens_media == 2202
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss] == ["[document]x"]


def test_ties_repeats_and_null_ids(spark):
    rows = [(None, 0, "user", "a"), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, None, "user", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", C.text_parts(F.col("text")))
    got = {r.conv_id: [x.text for x in r.turns] for r in C.format_chats(turns).select("conv_id", C.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert got == {None: ["a"], 2: ["z", "a", "a", "b"]}


def test_query(spark):
    rows = {r.conv_id: r for r in C.op6_chat_format(spark, "/root/testdata/sf0.001").collect()}
    t = C.TRAP
    assert rows[-7].turns_sha256 == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()
    assert rows[-7].loss_chars == len(t) and rows[-7].loss_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_empty_table(spark):
    assert C.format_chats(spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{C.PART}>")).count() == 0
