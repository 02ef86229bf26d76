import hashlib
import random

import duckdb
import pytest

from graftline.llm import chat
from graftline.llm.queries import ORACLE, QUERIES


def test_escape_round_trip():
    rng = random.Random(2)
    for _ in range(2000):
        t = "".join(rng.choices("<[\\/s>]INST|a", k=rng.randint(0, 12)))
        assert chat.unescape(chat.escape(t)) == t
        assert not any(x in chat.escape(t) for x in ("</s>", "<s>", "[INST]", "[/INST]", "<<", "<|"))


def test_parts_and_roles(spark):
    schema = f"conv_id long, turn long, role string, parts {chat.PARTS}, text int, formatted int"
    part = lambda kind, **x: (kind, x.get("text"), x.get("ref"), x.get("width"), x.get("height"), x.get("duration_ms"), x.get("pages"))
    rows = [
        (1, 0, "user", [part("text", text="see <|image|>"), part("image", ref="a.png", width=57, height=28), part("audio", ref="b", duration_ms=100), part("document", ref="c.pdf", pages=2)], 0, 0),
        (1, 1, "assistant", [part("text", text="</s>"), part("text", text=None)], 0, 0),
        (1, 1, "assistant", [part("text", text="</s>"), part("text", text=None)], 0, 0),
        (2, None, None, None, 0, 0),
        (2, 3, "tool <x>", [part("text", text="[INST]")], 0, 0),
        (None, 0, "system", [part("text", text="")], 0, 0),
    ]
    turns = chat.format_turns(spark.createDataFrame(rows, schema))
    got = {(r.conv_id, r.turn, r.formatted): r for r in turns.collect()}
    first = next(r for k, r in got.items() if k[:2] == (1, 0))
    assert first.formatted == "[INST] see <\\|image|><|image|><|audio|><|document|> [/INST]"
    assert [(a.kind, a.ref, a.tokens, first.formatted[a.position :][: len(a.kind) + 4]) for a in first.attachments] == [("image", "a.png", 3, "<|image|>"), ("audio", "b", 3, "<|audio|>"), ("document", "c.pdf", 1024, "<|document|>")]
    assert first.expanded_tokens == 1030
    d = {r.conv_id: r for r in chat.digests(chat.conversations(turns)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert d[1].n_turns == 3 and d[1].loss_chars == 8 and d[1].loss_sha256 == sha("</s></s>")
    assert d[2].turns_sha256 == sha("\n\ntool <x>\n[INST]\n") and d[None].turns_sha256 == sha("system\n\n")
    assert chat.digests(chat.conversations(turns.limit(0))).collect() == []
    text = "".join(r.formatted for r in sorted(turns.filter("conv_id = 1").collect(), key=lambda r: (r.turn, r.formatted)))
    for n in (1, 7, 10_000):
        rows = sorted(chat.conversations(turns, n).filter("conv_id = 1").collect(), key=lambda r: r.chunk)
        assert "".join(r.text for r in rows) == text and [r.chunk for r in rows] == list(range(len(rows)))
        assert [r.whole for r in rows] == [n > len(text)] * len(rows) and [r.last for r in rows] == [False] * (len(rows) - 1) + [True]


def test_attachments_are_stored_with_the_conversation(spark):
    """References, places and token counts come with the stored text, whatever its rows; a kind without a visitor has a placeholder too."""
    part = lambda kind, **x: (kind, x.get("text"), x.get("ref"), x.get("width"), x.get("height"), x.get("duration_ms"), x.get("pages"))
    rows = [(1, 0, "user", [part("text", text="a<b"), part("image", ref="a.png", width=57, height=28), part("video", ref="v", duration_ms=9)]), (1, 1, "assistant", [part("audio", ref="b", duration_ms=100), part("text", text="[x]")]), (2, 0, "user", [part(None, text="t")])]
    turns = chat.format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}"))
    for n in (5, 1 << 20):
        texts = chat.conversations(turns, n)
        own = sorted(texts.filter("conv_id = 1").collect(), key=lambda r: r.chunk)
        text, found = "".join(r.text for r in own), [a for r in own for a in r.attachments]
        assert [(a.kind, a.ref, a.tokens) for a in found] == [("image", "a.png", 3), ("video", "v", 0), ("audio", "b", 3)]
        assert [text[a.position :].startswith(m) for a, m in zip(found, ("<|image|>", "<|attachment|>", "<|audio|>"), strict=True)] == [True] * 3
        assert {r.conv_id: (r.n_attachments, r.expanded_tokens) for r in chat.digests(texts).collect()} == {1: (3, 6), 2: (0, 0)}


def test_conversations_come_back_from_their_text(spark):
    """Turns, texts and the masked text against the rows, however the text is cut into rows."""
    rng = random.Random(3)
    odd = ["", "\n", " ", "</s>", "[/INST]", " [/INST]", "<s>", "\n<</SYS>>", "<<ROLE>>x<</ROLE>>\n", "\n<</TURN>>", "<", "[", "\\", "<\\", "[\\", "é<", "日[", "<|image|>", "a " * 50]
    rows = []
    for conv in range(40):
        for turn in range(rng.choice([1, 2, 5, 30])):
            rows.append((conv, turn, rng.choice(["user", "assistant", "assistant", "system", "tool <s>", ""]), "".join(rng.choices(odd, k=rng.randint(0, 6)))))
    rows += [(7000, 0, "assistant", "x<" * 5000), (7000, 1, "user", None), (None, 0, "user", "a")]
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], "conv_id long, turn long, role string, text string, chunk int, loss string").repartition(3).withColumn("parts", chat.text_part())
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        said, loss = "".join(f"{role}\n{t or ''}\n" for *_, role, t in own), "".join(t or "" for *_, role, t in own if role == "assistant")
        want[conv] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for n in (3, 64, 1 << 20):
        got = chat.format_and_read_back(df, n).collect()
        assert {r.conv_id: tuple(r)[1:5] for r in got} == want and len(got) == len(want)
        assert next(r.formatted_chars for r in got if r.conv_id == 7000) == 3 + 15_000 + 4 + 7 + 8
    with pytest.raises(ValueError):
        chat.next_turn("no mark", 0)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in ("conversations", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(ORACLE[name]).fetchall()
    assert sorted(map(tuple, QUERIES[name](spark, sf).collect())) == sorted(want)
