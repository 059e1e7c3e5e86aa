"""Collapse of snapshots and rendering, against plain Python."""

import random

from mixframe.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part string, conv int, content string, row int"


def rendered(turns):
    return "".join(f"<|im_start|>{r or ''}\n{(t or '').replace('<|im_end|>', '< |im_end|>')}<|im_end|>\n" for r, t in turns)


def expected(rows, per_part):
    import hashlib

    md5 = lambda t: "" if t is None else hashlib.md5(t.encode()).hexdigest()
    said = {}
    for conv in {r[0] for r in rows}:
        own = {r[1:] for r in rows if r[0] == conv}
        own = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "", md5(r[2])))
        said[conv] = tuple((r[1], r[2]) for r in own)
    kinds = {}
    for conv, turns in said.items():
        kinds.setdefault(turns, []).append(conv)
    begun = {turns[:k] for turns in kinds for k in range(1, len(turns))}
    out = set()
    for turns, convs in kinds.items():
        if turns not in begun:
            named = [c for c in convs if c is not None]
            first = min(named) if named else None
            for part in range(0, (len(turns) - 1) // per_part + 1):
                out.add((first, part, len(turns), len(convs), rendered(turns[part * per_part : (part + 1) * per_part])))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)


def test_collapse_matches_plain_version(spark):
    random.seed(1)
    rows = []
    for conv in range(60):
        base = random.randrange(8)
        rows += [(conv, k, "user" if k % 2 else None, f"said {base} {min(k, 3 + conv % 3)}") for k in range(1 + conv % 7)]
    rows += [(100, k, "user", f"long {k}") for k in range(400)] + [(101, k, "user", f"long {k}") for k in range(350)]  # a hot one
    rows += [(100, k, "user", f"long {k}") for k in range(0, 400, 2)]  # repeated rows
    rows += [(200, None, "a", "last"), (200, 1, "b", None), (200, 1, "b", ""), (200, 1, None, "<|im_end|>x"), (None, 0, "c", "y")]
    rows += [(201, 5, "u", "gap"), (201, 9, "u", "gap2"), (202, 0, "u", "gap")]  # 202 is a prefix by position
    found = {tuple(r) for r in chat.format_chats(table(spark, rows), turns_per_part=64).collect()}
    assert found == expected(rows, 64)


def test_empty(spark):
    assert chat.format_chats(table(spark, [])).collect() == []
