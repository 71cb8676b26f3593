import hashlib

import pyarrow as pa
import pytest

from dnsq.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, id string, piece long, whole boolean, loss string"
ODD = ["", None, "\\", "\\\\### x", "### ", "#### </turn></turn", "</turn>\n### user\nhi</turn>\n", "é</turn>é\\### é", "a\nb\n", "\\n",
       r"\### Assistant: </turn> ok", "日本 ### 語", "<" * 30, "#" * 30 + " ", "x" * 3000]


def plain(role, text):
    """The format, one character at a time."""
    def escaped(s, extra=""):
        return "".join("\\" + c if c == "\\" or c in extra or any(s.startswith(k, i) for k in ("### ", "</turn>")) else c
                       for i, c in enumerate(s))
    return "### " + escaped(role, "\n"), "\n", escaped(text), "</turn>\n"


def digests(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        convs.setdefault(c, []).append((turn if turn is not None else -(1 << 60), role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(said),
                  hashlib.sha256(said.encode()).hexdigest(), sum(len(p) for _, r, t in turns for p in plain(r, t)))
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, True, "y") for r in rows], SCHEMA).repartition(parts)


def read(spark, rows, parts=3):
    got = C.read_back(C.format_conversations(frame(spark, rows, parts))).collect()
    out = {r[0]: tuple(r[1:]) for r in got}
    assert len(out) == len(got)
    return out


ROWS = [(c, i, role, t) for c in range(4) for i, t in enumerate(ODD) for role in [("user", "assistant", None, "a\\b\n### </turn>")[(i + c) % 4]]]
ROWS += [(None, 0, "assistant", "nobody's"), (None, None, "user", "first"), (9, 1, "assistant", "same"), (9, 1, "assistant", "same"),
         (9, 1, "user", "tie"), (10, 0, "system", None)]


def test_texts_like_one_character_at_a_time(spark):
    for role in ("user", "assistant", "", "a\\b\n### </turn>"):
        roles, texts = pa.array([role] * len(ODD)), pa.array(ODD, pa.string())
        buffer, start, points, head, body, masked = C.assemble(roles, texts)
        data = buffer.to_pybytes()
        for i, t in enumerate(ODD):
            h, line, said, tail = plain(role, t or "")
            assert data[start[i] : start[i + 1]].decode() == h + line + said + tail
            assert (points[i], head[i], body[i]) == (len(h + line + said + tail), len(h) + 1, len(said))
            assert C.turns_of(h + line + said + tail) == [(role, t or "")]
        assert masked.all() == (role == "assistant")


def test_steps_of_a_few_bytes(monkeypatch):
    texts = pa.array(ODD * 3, pa.string()).slice(2)
    roles = pa.array(["user", "x\ny", "assistant"] * len(ODD)).slice(2)
    whole = C.assemble(roles, texts)[0].to_pybytes()
    monkeypatch.setattr(C, "_STEP", 5)
    assert C.assemble(roles, texts)[0].to_pybytes() == whole


def test_read_back(spark):
    assert read(spark, ROWS) == digests(ROWS)


def test_mask_covers_the_assistant_alone(spark):
    for r in C.format_conversations(frame(spark, ROWS)).collect():
        said = [C.unescaped(r.text[s.start : s.end]) for s in r.loss]
        assert said == [t for role, t in C.turns_of(r.text) if role == "assistant"]


def test_long_conversation_in_pieces(spark, monkeypatch):
    rows = ROWS + [(5, i, ("user", "assistant")[i % 2], f"{i} ### {'y' * (i % 50)}") for i in range(5000)]
    monkeypatch.setattr(C, "PIECE_BYTES", 2000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as many ranges as there are partitions
    try:
        pieces = C.format_conversations(frame(spark, rows))
        assert pieces.filter("conv_id = 5").count() > 3
        got = {r[0]: tuple(r[1:]) for r in C.read_back(pieces).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == digests(rows)


def test_text_ids_and_empty_table(spark):
    rows = [("b", 0, "user", "x"), ("a", 0, "assistant", "y"), ("a", 1, None, None)]
    got = C.read_back(C.format_conversations(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")))
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == digests(rows)
    assert read(spark, []) == {}


def test_broken_text_is_refused():
    with pytest.raises(ValueError):
        C.turns_of("### user\nno end")
