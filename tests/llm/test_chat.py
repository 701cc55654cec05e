import hashlib

from hotspan.llm.chat import format_chats, parse, read_back

TURNS = "conv_id bigint, turn bigint, role string, text string, formatted int"
TRICKY = "\\### Assistant: </turn> ok"


def test_formats_read_back_exactly(spark):
    rows = [
        (1, 0, "user", TRICKY), (1, 1, "assistant", TRICKY + "\n\\h<#:"), (1, 2, "assistant", None), (2, 0, None, "é日本"),
        (3, 1, "a: #<\\b", "x"), (3, 1, "a: #<\\b", "x"), (3, 0, "assistant", "y" * 300_000), (None, 0, "user", ""),
    ]
    turns = spark.createDataFrame([(*r, 7) for r in rows], TURNS)
    out = format_chats(turns)
    found = {r["conv_id"]: r for r in out.collect()}
    assert set(found) == {1, 2, 3, None}
    for conv, row in found.items():
        mine = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1], r[2] or "", r[3] or ""))
        data = row["formatted"].encode()
        assert [(a.decode(), b.decode()) for a, b in parse(data)] == [(r[2] or "", r[3] or "") for r in mine]
        assert b"###" not in data.replace(b"### ", b"", len(mine)) and data.count(b"</turn>") == len(mine)
    digests = {r["conv_id"]: r for r in read_back(out).collect()}
    loss = TRICKY + "\n\\h<#:"
    assert digests[1]["loss_chars"] == len(loss)
    assert digests[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert digests[2]["loss_chars"] == 0 and digests[3]["n_turns"] == 3
    assert digests[1]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows[:3]).encode()).hexdigest()


def test_empty_table(spark):
    assert read_back(format_chats(spark.createDataFrame([], TURNS))).count() == 0
