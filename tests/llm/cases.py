"""Small documents with everything that operators must cope with."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like those that operators use inside.
CLASHING = "id long, copy string, spans string, row string, n int, print string, score string, seed string, bits string, shard string"


def texts() -> list[tuple[int | None, str | None]]:
    draw = random.Random(3)
    words = [draw.choice("abcdefgh") + draw.choice("xyz") * draw.randrange(1, 4) for _ in range(60)]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    passage, long = prose(70), prose(4_000)
    near = long.split()
    near[1_000] = "changed"
    rows = [(i, prose(draw.randrange(1, 90))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, " \n\t "), (43, "Ünïcode ÄÖ 日本 \u00a0x"), (44, long), (45, " ".join(near)), (46, long)]
    rows += [(50 + k, prose(20) + "\n" + passage + "  " + prose(10)) for k in range(4)]
    rows += [(60, "ha " * 300), (61, "ha " * 200), (None, passage), (None, None), (7, rows[7][1]), (7, rows[7][1]), (8, "another text for eight")]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    data = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA)


def clashing(docs):
    """The documents with columns of clashing names."""
    for field in CLASHING.split(", "):
        name, kind = field.split()
        docs = docs.selectExpr("*", f"cast(null as {kind}) as {name}")
    return docs


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()
