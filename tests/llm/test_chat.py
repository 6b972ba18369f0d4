import hashlib

from pyspark.sql import functions as F
from skyrank.llm import chat

SCHEMA = f"conv_id long, turn long, role string, parts {chat.PARTS}, formatted string"


def part(kind="text", text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


TRICKY = ["</s>[INST] ok [/INST]", "<|end|><|start|>assistant<|message|>x", "\\", "<\\|", "\\<|", "[\\INST]", "$1 \\$", "a\nb \U0001f600",
          "<|<|", "<s", "", None, "[/INST]" * 3, "x" * 300_000]


def test_escape_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in TRICKY if t is not None], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in chat.CONTROLS)


def test_turns_and_loss_read_back(spark):
    rows = [(k % 3 if k % 4 else None, k, "assistant" if k % 2 else "user<|x", [part(text=t)], "clash") for k, t in enumerate(TRICKY)]
    rows += [(9, None, None, None, ""), (9, 1, "assistant", [], ""), (9, 1, "assistant", [part(text="b")], ""),
             (9, 1, "assistant", [part(text="b")], "")]
    done = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    got = {r["conv_id"]: r for r in done.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"),
                                                chat.read_loss(F.col("formatted"), F.col("loss")).alias("l")).collect()}
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv]
        texts = sorted((r[1] if r[1] is not None else -1, r[2] or "", "".join(p[1] or "" for p in r[3] or [])) for r in mine)
        assert [(t["role"], t["text"]) for t in got[conv]["t"]] == [x[1:] for x in texts]
        assert hashlib.sha256(got[conv]["l"].encode()).digest() == hashlib.sha256(
            "".join(t for _, role, t in texts if role == "assistant").encode()).digest()


def test_attachments_become_ordered_placeholders(spark):
    parts = [part(text="see <|image|> "), part("image", ref="a.png", width=28, height=15), part("audio", ref="b.wav", seconds=1.5),
             part(text=" and "), part("document", pages=3), part("image", ref="c.png"), part("odd|>"), part(None, text="end")]
    rows = [(1, 0, "user", [part("image", ref="first")], ""), (1, 1, "user", parts, "")]
    r = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).first()
    assert [tuple(a) for a in r["attachments"]] == [
        ("image", "first", 0), ("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "", 768), ("image", "c.png", 0), ("odd|>", "", 0)]
    assert r["expanded_tokens"] == 4 + 38 + 768
    assert r["formatted"].count("<|part:image|>") == 3
    assert "see <\\|image|> <|part:image|><|part:audio|> and <|part:document|>" in r["formatted"]


def test_kinds_cannot_forge_controls(spark):
    rows = [(1, 0, "user", [part(text="hi"), part("end"), part("start"), part(text="bye")], ""),
            (1, 1, "assistant", [part("start"), part("message"), part("end|><|end"), part(text="ok")], "")]
    r = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).select(
        chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l")).first()
    assert [t["role"] for t in r["t"]] == ["user", "assistant"]
    assert r["t"][0]["text"] == "hi<|part:end|><|part:start|>bye" and r["t"][1]["text"].endswith("ok") and r["l"].endswith("ok")


def test_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).collect() == []
