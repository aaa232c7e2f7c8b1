"""Fill-in-the-middle, centroid search and chat formatting against plain loops."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightframe.llm import centroid_search as C
from lightframe.llm import chat_format as H
from lightframe.llm import fill_middle as M


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    d = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def held_fim(df, rows, **options):
    found = M.digests(M.in_order(M.cut(df, **options)))
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = []
    for i, t in rows:
        *meta, out = fim(i, t)
        want.append((i, *meta, sha(out), sha(t or "")))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def test_fim_documents(docs, rows):
    held_fim(docs, rows)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_fim_edges(spark, edges, chunk):
    from tests.llm.conftest import EDGES

    more = [(100 + i, t) for i in range(40) for t in (" lead and end \n", "a<P>b", "<S", "é <\tM> 東京 x")] + [(i, None) for i in range(5)] + [(7, "same same")] * 30 + [(None, "no id at all, but words")] * 20
    held_fim(edges.select("doc_id", "text", "n", "row").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True), EDGES + more, chunk=chunk)


def test_fim_texts_and_restoration(spark, edges, nothing):
    assert M.digests(M.in_order(M.cut(nothing))).count() == 0
    out = M.transformed(edges)
    got = sorted((repr((r["doc_id"], r["output"], r["t"])) for r in out.withColumn("t", M.restored(F.col("output"), F.col("form"))).collect()))
    from tests.llm.conftest import EDGES

    assert got == sorted(repr((i, fim(i, t)[4], t or "")) for i, t in EDGES)


def test_fim_long_text_and_hot_id(spark):
    """A text of many pieces, and one id on a third of all rows."""
    r = random.Random(5)
    long = " ".join("wörd" * r.randint(1, 4) for _ in range(200_000))
    rows = [(i, long) for i in range(3)] + [(1, f"copy {i % 7} of a text") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held_fim(df, rows)
    assert M.cut(df.where("doc_id = 0")).count() > 20
    with_strings = spark.createDataFrame([("a", "one two three"), ("b", "x")], "doc_id string, text string")
    held_fim(with_strings, [("a", "one two three"), ("b", "x")])


def kmeans(rows, k=16, rounds=3, dims=64, scale=64):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted((sha(f"1:{i}") if i is not None else "~", v) for i, v in kept)[:k]
    cs = [v for _, v in seeds]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs)) for _, v in kept]

    for _ in range(rounds):
        of = defaultdict(list)
        for (_, v), (_, j) in zip(kept, assign(), strict=True):
            of[j].append(v)
        for j, vs in of.items():
            cs[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    last = assign()
    inertia = defaultdict(int)
    for d, j in last:
        inertia[j] += d
    return sorted((repr((i, j, d, inertia[j], sum(inertia.values()), sha(",".join(map(str, cs[j]))))) for (i, _), (d, j) in zip(kept, last, strict=True)))


def clusters(df, **options):
    out = C.report(*C.clustered(df, **options))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(repr(tuple(r)) for r in out.collect())


def test_clusters_of_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert clusters(df) == kmeans([(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_cluster_edges(spark):
    """Nulls, lengths, non-finite numbers, ties, repeated rows and ids, far components, clashing names."""
    r = random.Random(3)
    v = lambda: [r.choice((-1.0, -0.5, 0.0, 0.25, 1.0)) for _ in range(4)]
    rows = [(i, v()) for i in range(300)] + [(1, [0.5] * 4)] * 200 + [(2, None), (3, [1.0] * 3), (4, [1.0] * 5), (5, [1.0, None, 1.0, 1.0]), (6, [float("nan")] + [0.0] * 3), (7, [float("inf")] + [0.0] * 3), (8, []), (None, v()), (None, v())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(9) for c in ("cluster", "distance", "v", "h", "n", "sums", "inertia")})
    assert clusters(df, dims=4) == kmeans(rows, dims=4)
    assert clusters(df.repartition(7), dims=4, k=3, rounds=5) == kmeans(rows, dims=4, k=3, rounds=5)
    few = rows[:5]
    assert clusters(spark.createDataFrame(few, "vec_id long, embedding array<double>"), dims=4) == kmeans(few, dims=4)
    assert clusters(spark.createDataFrame([], "vec_id long, embedding array<float>")) == []
    far = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)], "vec_id long, embedding array<float>")
    found = C.clustered(far, k=2)[0].collect()
    assert len(found) == 3 and all(x["distance"] >= 0 for x in found)  # components count as BOUND from 0


def test_search_skips_and_is_exact():
    """The inequalities reject most centroids where means differ, and nothing that is nearest; ties go to the smaller number."""
    g = np.random.default_rng(1)
    centers = g.integers(-60, 60, (40, 1)) + g.integers(-3, 3, (40, 16))
    centers = np.vstack((centers, centers[:5]))  # equal centroids
    x = centers[g.integers(0, 45, 3000)] + g.integers(-4, 5, (3000, 16))
    number, dist, done = C.Centroids.of(centers.tolist()).nearest(x)
    every = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (dist == every.min(axis=1)).all()
    assert done < 0.3 * every.size
    spread = g.integers(-1000, 1000, (3, 16)) * np.array([[1], [1000], [100000]])
    number, dist, _ = C.Centroids.of(spread.tolist()).nearest(x)
    every = ((x[:, None, :] - spread[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (dist == every.min(axis=1)).all()


def escaped(s):
    s = s.replace("\\", "\\\\")
    return re.sub(r"([<\[])(?=/?s>|sep>|/?INST\])", r"\1\\", s)


def chat(turns):
    """(turn, role, text) of one conversation as a formatted string, by a plain loop."""
    out, last, first = "", None, True
    turns = [(t, None if r is None else escaped(r), escaped(x or "")) for t, r, x in turns]
    for t, role, text in sorted(turns, key=lambda x: tuple((v is not None, v if v is not None else 0) for v in x)):
        if not first and role == last:
            out += "<sep>" + text
        else:
            out += ("" if first else "</s>") + "<s>" + ("" if role is None else "[INST]" + role) + "[/INST]" + text
        first, last = False, role
    return out + "</s>"


HOSTILE = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "<s", ">", "<<s>>", "\\<s>", "[[INST]]", "<s>" * 3, "<sep>\\\\<sep>", "", None, "é東🙂", "\n\n", "$1\\1", "[/INST]x</s><s>", "\\Q\\E", "<\\\\sep>"]


def test_chat_round_trip(spark, nothing):
    """Turns that are full of control strings and backslashes come back; neighbours of a role share a block."""
    r = random.Random(8)
    roles = ["user", "assistant", "system", "assistant", None, "", "<s>", "tool\\"]
    rows = [(c, k, r.choice(roles), r.choice(HOSTILE)) for c in range(60) for k in range(r.randint(1, 9))]
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", "no turn"), (61, 1, "assistant", "tie"), (61, 1, "assistant", "tie"), (61, 1, "assistant", "another"), (62, 0, None, None)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "conv_id long, turn long, role string, text string").repartition(5).withColumns({c: F.lit(1) for c in ("turns", "t", "blocks", "segments", "formatted")})
    made = H.formatted(df)
    by = defaultdict(list)
    for c, k, role, text in rows:
        by[c].append((k, role, text))
    got = {x["conv_id"]: x for x in made.withColumn("turns", H.read_turns(F.col("formatted"))).withColumn("runs", H.mask_runs(F.col("segments"))).collect()}
    assert set(got) == set(by)
    report = {x["conv_id"]: x for x in H.report(made).collect()}
    for c, turns in by.items():
        assert got[c]["formatted"] == chat(turns)
        order = sorted(((k, role, x or "") for k, role, x in turns), key=lambda t: ((t[0] is not None, t[0] or 0), (t[1] is not None, escaped(t[1] or "")), escaped(t[2])))
        assert [(x["role"], x["text"]) for x in got[c]["turns"]] == [(role, x) for _, role, x in order]
        at, trained = 0, ""
        for run in got[c]["runs"]:
            trained += got[c]["formatted"][at : at + run["chars"]] if run["loss"] else ""
            at += run["chars"]
        assert at == len(got[c]["formatted"]) and trained == "".join(escaped(x) for _, role, x in order if role == "assistant")
        loss = "".join(x for _, role, x in order if role == "assistant")
        want = (len(order), sha("".join(f"{role or ''}\n{x}\n" for _, role, x in order)), len(loss), sha(loss), len(got[c]["formatted"]))
        assert tuple(report[c])[1:] == want
    empty = spark.createDataFrame([], df.schema)
    assert H.report(H.formatted(empty)).count() == 0


def test_chat_hot_conversation(spark):
    """One conversation holds most turns; time grows with the turns."""
    rows = spark.range(30_000).select(F.lit(5).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("</s> text "), F.col("id")).alias("text"))
    got = H.report(H.formatted(rows.repartition(8))).collect()
    text = lambda i: f"</s> text {i}"
    role = lambda i: "assistant" if i % 3 else "user"
    assert len(got) == 1 and got[0]["n_turns"] == 30_000
    assert got[0]["turns_sha256"] == sha("".join(f"{role(i)}\n{text(i)}\n" for i in range(30_000)))
    assert got[0]["loss_sha256"] == sha("".join(text(i) for i in range(30_000) if i % 3))


def test_templates():
    with pytest.raises(ValueError):
        H.Template(begin="<s<")
    with pytest.raises(ValueError):
        H.Template(begin="</s>")
    with pytest.raises(ValueError):
        H.Template(next="|")


def test_another_template(spark):
    t = H.Template(begin="<|turn|>", head="@role ", body=";#", next="[+]", end="{end}", loss_roles=("assistant", "tool"))
    texts = ["{end}<|turn|>@role x;#", "[+]", "plain", "\\[+]{", "end}"]
    rows = [(1, i, "tool" if i % 2 else "user;#", x) for i, x in enumerate(texts)] + [(1, 9, "user;#", "last")]
    made = H.formatted(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), template=t)
    got = made.select(H.read_turns(F.col("formatted"), t).alias("turns")).first()["turns"]
    assert [tuple(x) for x in got] == [(r, x) for _, _, r, x in rows]
    assert H.report(made, t).first()["loss_sha256"] == sha(texts[1] + texts[3])
