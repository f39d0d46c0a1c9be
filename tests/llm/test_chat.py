"""Transcripts against the plain decoder, however the rows are dealt out."""

import random

import pytest

from platen.llm import chat


def plain(lines, piece):
    """Rows (turn, piece, role, text, n_lines, rendered) of one transcript, line by line."""
    held = [x for x in lines if x.strip()]
    turns = []
    for line, state in zip(held, chat.decode(lines)):
        said, at = chat.marker(line)
        if state < 3 or not turns:
            turns.append((chat.ROLES[state % 3], []))
        turns[-1][1].append((line[at:] if said in (1, 2, 3) else line).strip())
    out = []
    for t, (role, bodies) in enumerate(turns):
        for p in range(0, len(bodies), piece):
            part = bodies[p : p + piece]
            text = "\n".join(x for x in part if x)
            out.append((t, p // piece, role, text, len(part), (f"<|{role}|>\n" if not p else "") + text + ("\n<|end|>" if p + piece >= len(bodies) else "")))
    return out


def transcript(r, n):
    return [r.choice(["User: ", "Assistant: ", "", "", "", "Bob: "]) + "x" * r.randint(1, 300) + r.choice(["", "?"]) if r.random() < 0.8 else "" for _ in range(n)]


@pytest.mark.parametrize("parts", [1, 2, 4, 8])
@pytest.mark.parametrize("segment", [7, 512])
def test_any_dealing_gives_the_plain_rows(spark, monkeypatch, parts, segment):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    monkeypatch.setattr(chat, "PIECE", 5)
    r = random.Random(6)
    talks = {1: transcript(r, 300), None: transcript(r, 40), 3: ["", "x", "", ""], 4: ["", " "], 5: transcript(r, 9), 6: transcript(r, 60)}
    rows = []
    for c, lines in talks.items():
        at = 0
        while at < len(lines):
            k = r.randint(1, 4)
            rows.append((c, at, "\n".join(lines[at : at + k]), "extra"))
            at += k
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sorted((tuple(x) for x in chat.parse(df).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])
    assert got == sorted(((c, *row) for c, lines in talks.items() for row in plain(lines, 5)), key=repr)


def test_odd_rows(spark):
    schema = "conv_id long, turn long, text string, piece int, rendered string"
    assert chat.parse(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 0, "User: hi", 3, "z"), (1, 0, "User: hi", 3, "z"), (1, None, "System: be brief", None, None), (None, None, None, None, None), (2, 1, "A: " + "long " * 50_000, 1, "q")]
    got = sorted((x.conv_id, x.turn, x.role) for x in chat.parse(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 0, "system"), (1, 1, "user"), (1, 2, "user"), (2, 0, "assistant")]
