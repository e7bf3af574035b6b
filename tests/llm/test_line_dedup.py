import random
import time
import zlib

from pyspark.sql import functions as F

from textquarry.llm import line_dedup as L
from tests.llm.conftest import DOCS


def brute(docs: list[tuple[int, str | None]], least: int) -> dict[int, list[int]]:
    """Lines that go, by comparing every position with every earlier one."""
    seqs = [(i, t.split("\n")) for i, t in sorted(docs) if t is not None]
    seen, out = [], {i: [] for i, _ in docs}
    for k, (i, lines) in enumerate(seqs):
        gone = set()
        for p in range(len(lines)):
            best = 0
            for kk, pp in seen:
                other, n = seqs[kk][1], 0
                while p + n < len(lines) and pp + n < len(other) and lines[p + n] == other[pp + n]:
                    n += 1
                best = max(best, n)
            seen.append((k, p))
            if best and sum(len(x.split()) for x in lines[p : p + best]) >= least:
                gone |= set(range(p, p + best))
        out[i] = sorted(gone)
    return out


def test_against_brute_force(spark):
    for seed, letters in ((1, 2), (2, 3), (3, 5)):
        rng = random.Random(seed)
        docs = [(i, "\n".join("ab cd ef"[: rng.randrange(1, 9)] + str(rng.randrange(letters)) for _ in range(rng.randrange(0, 14)))) for i in range(25)]
        docs += [(50, None), (51, ""), (52, "\n\n\n"), (53, docs[3][1]), (54, "\n".join(["a b c"] * 20))]
        got = {r.doc_id: r.lines_removed for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()}
        assert got == brute(docs, 4)


def test_one_copy_stays_and_other_columns(spark):
    run = "\n".join(f"line {k} of a passage with ten words in it" for k in range(8))
    docs = [(3, "top\n" + run, "x", 1), (1, run + "\nend", "y", 2), (2, "quite another text", "z", 3)]
    out = {r.doc_id: r for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string, th string, rank int")).collect()}
    assert out[1].text == docs[1][1] and out[3].text == "top" and out[3].th == "x" and out[3]["rank"] == 1


def test_query_and_empty(spark, table):
    run = "\n".join(f"line {k} of a passage with ten words in it" for k in range(8))
    rows = [(1, run, "en", "s", 1), (2, "a\n" + run + "\nb", "en", "s", 1), (3, None, None, None, None), (4, "x\ny", "en", "s", 3)]
    out = {r.doc_id: r for r in L.op2_line_dedup(spark, table("documents", rows, DOCS)).collect()}
    assert (out[1].n_lines, out[1].n_removed) == (8, 0) and (out[2].n_lines, out[2].n_removed) == (10, 8) and out[3].n_lines == 0
    assert out[2].kept_crc32 == zlib.crc32(b"a\nb")
    assert L.op2_line_dedup(spark, table("documents", [], DOCS)).count() == 0


def test_rows_that_repeat(spark):
    run = " ".join(["word"] * 60)
    docs = [(1, run), (1, run), (2, run)]
    out = sorted((r.doc_id, r.lines_removed) for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert out == [(1, []), (1, []), (2, [0])]


def test_null_ids(spark):
    run = " ".join(["word"] * 60)
    docs = [(None, run), (None, "a\n" + run), (None, None), (1, run)]
    out = {(r.doc_id, r.text, tuple(r.lines_removed)) for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(out) == 4 and sum(run in (t or "") for _, t, _ in out) == 1 and (1, "", (0,)) in out


def test_native_plan(spark, table):
    df = L.op2_line_dedup(spark, table("documents", [(1, "a\nb", "en", "s", 3)], DOCS))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_very_many_lines(spark):
    """A text of 60,000 lines, nearly all of them repeated: steps go with lines, not with their square."""
    run = "\n".join(f"line {k} of ten words or so that is here twice" for k in range(20_000))
    docs = [(1, run), (2, "top\n" + run + "\nmiddle\n" + run + "\nend")]
    began = time.time()
    out = {r.doc_id: r for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "text", F.size("lines_removed").alias("n")).collect()}
    assert out[1].n == 0 and out[2].n == 40_000 and out[2].text == "top\nmiddle\nend"
    assert time.time() - began < 300


def test_clashing_columns(spark):
    run = " ".join(["word"] * 60)
    docs = [(1, run, "a", 1, 2), (2, "x\n" + run, "b", 3, 4)]
    out = L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string, gone string, id int, lines_removed int"))
    assert out.columns == ["doc_id", "text", "gone", "id", "lines_removed"]
    assert sorted((r.doc_id, r.text, r.gone, r.id, r.lines_removed) for r in out.collect()) == [(1, run, "a", 1, []), (2, "x", "b", 3, [1])]
