"""Small tables with the awkward cases every operator must handle."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kid string, own string, parts int, score double, kept string"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n)]


def texts() -> list[tuple[int | None, str | None]]:
    base = words(1, 300)
    near = list(base)
    near[150] = "changed"
    shared = words(2, 60)
    rows: list[tuple[int | None, str | None]] = [(k, " ".join(words(10 + k, 80 + 7 * k))) for k in range(12)]
    rows += [(20, " ".join(base)), (21, " ".join(near)), (22, " ".join(base)), (22, " ".join(base))]  # near, exact and repeated rows
    rows += [(30, " ".join(words(3, 50) + shared + words(4, 50))), (31, "\n".join([" ".join(words(5, 40)), " ".join(shared), " ".join(words(6, 40))]))]
    rows += [(40, None), (41, ""), (42, " \t\n "), (None, "a null id"), (None, None), (43, "éé ü " * 30), (44, "ab " * 400), (45, "x")]
    rows += [(50, " ".join(words(7, 20_000)))]  # a very long text
    return rows


def documents(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "o", 1, 0.5, "x") for i, t in texts()], SCHEMA)


def empty(spark):
    return documents(spark).limit(0)
