import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def table(spark, tmp_path):
    """Writes rows as a table of a folder and returns the folder."""

    def put(name: str, rows: list, schema: str) -> str:
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def near_copies(seed: int = 1) -> list[tuple]:
    """Documents with exact copies, near copies, chains, short ones and hard cases."""
    rng = random.Random(seed)
    rows: list[tuple] = []

    def add(text):
        rows.append((len(rows) * 3 + 1, text, "en", f"s{len(rows) % 3}" if len(rows) % 7 else None, None if text is None else len(text)))

    for _ in range(12):
        base = words(rng, rng.randrange(30, 120), 10_000)
        add(" ".join(base))
        for _ in range(rng.randrange(0, 5)):
            other = list(base)
            for _ in range(rng.randrange(0, 8)):
                other[rng.randrange(len(other))] = f"x{rng.randrange(99999)}"
            add(" ".join(other))
    shared = words(rng, 60, 10_000)
    for _ in range(6):
        add(" ".join(words(rng, 60, 10_000) + shared))
    for t in [None, "", "  \n\t ", "one", "one", "One", "one two three four", "one two three four five", "ONE two three  four five", "\x0bone\x0ctwo three\x1cfour five six", "é ß ñ ü ö ä", "É ß ñ ü ö ä"]:
        add(t)
    add(" ".join(words(rng, 3000, 50)))
    return rows
