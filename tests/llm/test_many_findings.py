"""Texts with very many findings, and very many rows of one id and text: the same results in about linear time."""

from __future__ import annotations

import random
import string
import time

from pyspark.sql import functions as F

from lightframe.llm import secret_scan as S
from lightframe.llm import substring_dedup as D

from .test_corpus import brute_removed
from .test_texts import base_spans, check_scan, entropy_spans

CHARS = string.ascii_letters + string.digits


def test_many_findings_of_each_kind(spark):
    """Lists longer than a block of the running totals, with method spans inside, across and beside pattern matches."""
    r = random.Random(4)
    word = lambda n: "".join(r.choice(CHARS) for _ in range(n))
    parts = lambda: r.choice([f"token={word(8)}", f"secret: {word(40)}", word(40), "%032x" % r.getrandbits(128), "AKIA" + "ABCDEFGHIJ234567" + "Z" * r.randint(0, 9), "é plain words", f"{word(30)} password='{word(3)}'", "🙂"])
    texts = {0: " ".join(parts() for _ in range(900)), 1: "".join(word(40) + "a" * 40 for _ in range(150)), 2: word(9000), 3: "token=abcdef1 " * 700}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_scan(df, texts)
    got = {x["doc_id"]: x["x"] for x in S.scan(df, keep_text=True).select("doc_id", S.redacted(F.col("text"), F.col("spans")).alias("x")).collect()}
    for i, t in texts.items():
        base = base_spans(t)
        new = [z for z in entropy_spans(t) if not any(b[0] <= z[0] and b[2] >= z[2] for b in base)]
        out, at = "", 0
        for a, _, z in sorted(base + new):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, z)
        assert got[i] == out + t[at:]


def test_findings_cost_linear_time(spark):
    def seconds(n: int) -> float:
        df = spark.createDataFrame([(1, "token=abcdef1 " * n)], "doc_id long, text string")
        began = time.time()
        row = S.scan(df, keep_text=True).select(F.size("spans").alias("n"), F.length(S.redacted(F.col("text"), F.col("spans"))).alias("left")).first()
        assert (row["n"], row["left"]) == (n, 9 * n)
        return time.time() - began

    seconds(100)
    few, many = seconds(8000), seconds(32_000)
    assert many < 4 * few + 8


def test_many_rows_of_one_id_and_text(spark):
    """5,000 equal rows of a null id cost about what 5,000 ids do, and as many rows of a known id."""
    r = random.Random(6)
    text = " ".join("".join(r.choice(string.ascii_lowercase) for _ in range(5)) for _ in range(200))
    other = " ".join(text.split()[:60]) + " and another end"
    took = {}
    for name, ids in {"distinct": range(5000), "null": [None] * 5000, "one": [7] * 4000 + [None] * 1000}.items():
        rows = [(i, text) for i in ids] + [(9999, other), (10_000, "short")]
        began = time.time()
        got = sorted(repr(tuple(x)) for x in D.report(D.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))).collect())
        took[name] = time.time() - began
        # two rows of the text are enough for what more of them do
        few = list(brute_removed([(0, text), (1, text), (9999, other), (10_000, "short")], 35))
        want = [(*((i, text, few[0]) for i in ids),), (9999, other, few[2]), (10_000, "short", few[3])]
        assert got == sorted(repr((i, *f[1:])) for i, _, f in (*want[0], *want[1:]))
    assert max(took["null"], took["one"]) < 2 * took["distinct"] + 10


def test_archives_of_others_and_overwrites(spark, tmp_path):
    """A list never hides archives that another program wrote; an overwrite takes the old archives with it; ids that don't fit fail."""
    import zipfile

    import pytest

    from lightframe.llm import media_archive as M

    rows = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    foreign = tmp_path / "foreign"
    foreign.mkdir()
    with zipfile.ZipFile(foreign / "a.zip", "w") as z:
        z.writestr("x.bin", b"x")
    with pytest.raises(Exception, match="overwrite, or choose another"):
        M.write(rows, str(foreign))
    assert [r["member"] for r in M.read(spark, str(foreign)).collect()] == ["x.bin"] and [f.name for f in foreign.iterdir()] == ["a.zip"]
    path = tmp_path / "own"
    M.write(rows, str(path))
    old = {f.name for f in path.glob("*.zip")}
    M.write(rows, str(path), overwrite=True)
    assert len(list(path.glob("*.zip"))) == 1 and not old & {f.name for f in path.glob("*.zip")}
    with pytest.raises(Exception, match="doesn't fit"):
        M.write(spark.createDataFrame([("x" * 70_000, "t")], "doc_id string, text string"), str(tmp_path / "long"))
