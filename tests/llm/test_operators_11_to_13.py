"""Prefix trie, line dedup and vector codes: against plain Python, on odd rows, and with hot groups."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import line_dedup, prefix_trie, vector_codes

CHAT = "conv_id long, turn long, role string, text string"


def plain_trie(said):
    """The nodes of ``{conv_id: [(role, text), ...]}`` by walking over all prefixes."""
    members, nodes = {}, []
    for c, turns in said.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for path, ids in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = sorted(c for c in ids if len(said[c]) == len(path))
        nodes.append(
            (
                min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), sum(len(p) == len(path) + 1 for p in below),
                sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in below),
                sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(nodes, key=str)


def plain_rebuilt(said):
    out = {}
    for c, turns in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = c % 5 if c >= 0 else -(-c % 5)
        out[c] = said.get(c - rest, [])[:h] + turns[h:]
    return out


def trie_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(names).collect()), key=str)


def chats(spark, said):
    rows = [(c, t, role, text) for c, turns in said.items() for t, (role, text) in enumerate(turns)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, CHAT)


def test_trie_with_a_hot_beginning_and_many_copies(spark):
    rng = random.Random(5)
    said = {}
    for c in range(-40, 1200):
        first = ("system", "same") if c % 3 else ("user", f"u{rng.randrange(40)}")
        said[c] = [first, *[(rng.choice(["user", "assistant"]), rng.choice("abc")) for _ in range(rng.randrange(5))]]
    for c in range(2000, 2400):
        said[c] = [("system", "same"), ("user", "copy"), ("assistant", "é" * 30)]
    df = prefix_trie.prefix_trie(prefix_trie.sequences(chats(spark, said)))
    assert trie_rows(df) == plain_trie(said)


def test_trie_query_rebuilds_conversations(spark, tmp_path):
    rng = random.Random(6)
    said = {c: [(rng.choice(["user", "assistant"]), rng.choice("ab")) for _ in range(rng.randrange(1, 12))] for c in [*range(-12, 60), 10**12, 10**12 + 3]}
    chats(spark, said).write.parquet(f"{tmp_path}/conversations.parquet")
    assert trie_rows(prefix_trie.op11_prefix_trie(spark, str(tmp_path))) == plain_trie(plain_rebuilt(said))


def test_trie_of_one_very_long_conversation(spark):
    said = {1: [("user", str(i % 7)) for i in range(3000)], 2: [("user", str(i % 7)) for i in range(2999)]}
    rows = trie_rows(prefix_trie.prefix_trie(prefix_trie.sequences(chats(spark, said))))
    assert len(rows) == 3001 and sum(r[5] for r in rows) == 3001 and max(r[6] for r in rows) == 2999


def test_trie_odd(spark):
    rows = [
        (1, None, None, "x"), (1, 0, "user", None), (1, 0, "user", None), (2, None, "", "x"), (2, 0, "user", ""), (None, 0, "user", "lost"), (None, None, None, None),
        (3, 5, "assistant", "y" * 200_000), (3, 5, "user", "z"),
    ]
    df = spark.createDataFrame(rows, CHAT).withColumns({c: F.lit(7) for c in ("a", "b", "turns", "path", "depth", "ids", "key", "bytes", "lead", "block", "leaf")})
    said = {1: [("", "x"), ("user", ""), ("user", "")], 2: [("", "x"), ("user", "")], 3: [("assistant", "y" * 200_000), ("user", "z")]}
    assert trie_rows(prefix_trie.prefix_trie(prefix_trie.sequences(df))) == plain_trie(said)
    assert prefix_trie.prefix_trie(prefix_trie.sequences(df.limit(0))).count() == 0


def test_end_list_over_many_batches():
    batches = [pa.RecordBatch.from_pydict({"a": [1, 1], "b": [2, 2], "ids": [[i, i + 1], [i + 2]]}) for i in range(0, 30, 3)]
    batches.append(pa.RecordBatch.from_pydict({"a": [1], "b": [3], "ids": [[9]]}))
    found = pa.Table.from_batches(prefix_trie.list_digests(iter(batches))).to_pylist()
    assert [r["ends_sha256"] for r in found] == [hashlib.sha256(t.encode()).hexdigest() for t in (",".join(map(str, range(30))), "9")]


def plain_lines(docs):
    """``{(id, text): (lines, dropped, kept)}``."""
    blank, where = " \t\n\x0b\x0c\r", {}
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(blank))
    for i, text in docs:
        for line in (text or "").split("\n"):
            where.setdefault(key(line), set()).add(i)
    low = lambda i: (i is not None, i or 0)
    gone = {k: max(v, key=low) for k, v in where.items() if len(k) >= 20 and len(v) >= 3}
    out = {}
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [line for line in lines if gone.get(key(line), i) == i]
        out[i, text or ""] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def line_rows(df, docs):
    found = df.collect()
    assert len(found) == len(docs)
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept) for r in found)


def test_lines_against_python_with_hot_lines_and_long_texts(spark):
    rng = random.Random(8)
    pool = [f"Line number {i} of the pool, long enough" for i in range(60)] + ["short one", "", "ÄÖÜ line in another script é", "  \x1c padded line of some length \r"]
    docs = [(i, "\n".join([*("LICENSE text that a third of all rows have" for _ in range(i % 3 == 0)), *rng.choices(pool, k=rng.randrange(6)), f"own line of document {i}"])) for i in range(300)]
    docs += [(1000, "\n".join(rng.choices(pool, k=3000))), (1001, ("x" * 50_000 + "\n") * 3), (1002, "x" * 50_000), (1003, "X" * 50_000 + "\t")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted((str(i), *r) for (i, _), r in plain_lines(docs).items())
    assert line_rows(line_dedup.deduplicated(df), docs) == want
    for ranges in (1, 50):
        maps = line_dedup.dropped_lines(df, ranges=ranges).collect()
        assert {r.doc_id: r.n_dropped for r in maps} == {i: n for (i, _), (_, n, _) in plain_lines(docs).items() if n}
        assert all(w.dropped != 0 for r in maps for w in r.bitmap)


def test_lines_odd(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    more = [(i, f"a shared line of more than twenty\nown {n} {i}\n\n") for n, i in enumerate([None, None, 20, 20, 21, 21])]
    more += [(22, "nothing\r\nA SHARED LINE of more than twenty \n"), (22, "nothing\r\nA SHARED LINE of more than twenty \n"), (None, None)]
    df = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    want = plain_lines(rows + more)
    assert line_rows(line_dedup.deduplicated(df), rows + more) == sorted((str(i), *want[i, t or ""]) for i, t in rows + more)
    assert line_dedup.deduplicated(none).count() == 0 and line_dedup.dropped_lines(none).count() == 0


def test_lines_plan_has_no_python(spark, sf):
    plan = line_dedup.op12_line_dedup(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("size", [50, 1 << 20, 1 << 30, 1 << 44, 1 << 55])
def test_limb_products_are_exact(size):
    rng = np.random.default_rng(1)
    q = 16 if size < 1 << 40 else 1
    a, b = (rng.integers(-size, size + 1, (40, q)) for _ in range(2))
    b = b if size < 1 << 40 else b % 100 - 50
    want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
    assert vector_codes.exact_products(a, b).tolist() == want


def test_float_products_would_be_wrong():
    a, b = np.array([[(1 << 31) - 1, 1]]), np.array([[(1 << 31) - 1, 1]])
    assert vector_codes.exact_products(a, b)[0, 0] == ((1 << 31) - 1) ** 2 + 1 != int((a.astype(float) @ b.T.astype(float))[0, 0])


def plain_codes(rows):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    q = len(kept[0][1]) // 4
    books = [[v[p * q : p * q + q] for _, v, _ in kept[:256]] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            told = {}
            for _, v, _ in kept:
                told.setdefault(near(v[p * q : p * q + q], books[p])[1], []).append(v[p * q : p * q + q])
            books[p] = [[sum(c) // len(told[n]) for c in zip(*told[n], strict=True)] if n in told else e for n, e in enumerate(books[p])]
    out, sums = [], {}
    for i, v, label in kept:
        found = [near(v[p * q : p * q + q], books[p]) for p in range(4)]
        out.append((str(i), "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), label))
        sums[label] = sums.get(label, 0) + out[-1][2]
    return sorted((*r[:3], sums[r[3]]) for r in out), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def codes_of(spark, tmp_path, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumns({c: F.lit(7) for c in ("v", "code", "part", "entry", "n", "of", "error")})
    path = f"{tmp_path}/{kind}{len(rows)}"
    df.write.parquet(f"{path}/embeddings.parquet")
    found = vector_codes.op13_vector_codes(spark, path).collect()
    return sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in found), {r.codebooks_sha256 for r in found}


def test_codes_on_odd_vectors(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], rng.choice([1, 2, None])) for i in range(400)]
    rows += [(400 + i, [0.5] * 8, 3) for i in range(150)] + [(7, [0.25] * 8, 1), (None, [-0.1] * 8, None), (None, [3000.7] * 8, 2)]
    rows += [(600, None, 1), (601, [None] * 8, 1), (602, [float("nan")] * 8, 1), (603, [1.0] * 7 + [float("-inf")], None)]
    found, digest = codes_of(spark, tmp_path, rows, "double")
    want, told = plain_codes(rows)
    assert found == want and digest == {told}


def test_codes_of_few_and_of_no_vectors(spark, tmp_path):
    rows = [(3, [0.5, -0.5, 1.0, 2.0], None), (1, [0.5, -0.5, 1.0, 2.0], None), (2, [9.0, 9.0, 9.0, 9.0], 4)]
    found, digest = codes_of(spark, tmp_path, rows)
    assert (found, digest) == (plain_codes(rows)[0], {plain_codes(rows)[1]})
    assert codes_of(spark, tmp_path, [(1, None, 1)]) == ([], set())
    assert codes_of(spark, tmp_path, []) == ([], set())
    with pytest.raises(ValueError, match="one length"):
        codes_of(spark, tmp_path, [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)])
    with pytest.raises(Exception, match="too large"):
        codes_of(spark, tmp_path, [(n, [1e9] * 4, 1) for n in range(5)])
