"""Periodic runs, the join of embeddings and the repair of conversations, against brute force."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from varloom import scratch
from varloom.llm import common, dialogue, periodic, suffixtree, vectorjoin
from varloom.llm import queries as Q

SPACES = " \t\n\x0b\x0c\r"


def brute_runs(w):
    out = set()
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                seg = w[i : j + q]
                if not any(all(seg[t] == seg[t + p] for t in range(len(seg) - p)) for p in range(1, q)):
                    out.add((i, len(seg), q))
            i = max(j, i) + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def made_words(rng):
    w, letters = [], rng.choice([1, 2, 3, 5, 40])
    for _ in range(rng.randint(0, 6)):
        if rng.random() < 0.6:
            p = rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15, 16, 17, 31, 33])
            base = [rng.randrange(letters) for _ in range(p)]
            if rng.random() < 0.4:  # a period with a period inside
                base = (base[: max(1, p // 4)] * 9)[:p]
                base[-1] = rng.randrange(letters + 1)
            w += [base[i % p] for i in range(rng.randint(p, p * rng.randint(2, 6)))]
        else:
            w += [rng.randrange(letters) for _ in range(rng.randint(0, 30))]
    return [f"w{x}" for x in w]


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_a_piece(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = [made_words(rng) for _ in range(rng.randint(1, 4))]
        data = [" ".join(t).encode() for t in texts]
        at = np.concatenate(([0], np.cumsum([len(d) for d in data])))
        got = [list(zip(*(x.tolist() for x in r[1:]))) for r in periodic.piece_runs(np.frombuffer(b"".join(data), np.uint8), at, [None] * len(texts))]
        assert got == [brute_runs(t) for t in texts]


def test_wavelet_tree_successors():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 64, 100):
        values = rng.permutation(n)
        tree = periodic.WaveletTree(values)
        low = rng.integers(0, n, 200)
        high = np.minimum(n, low + rng.integers(0, n + 1, 200))
        x = rng.integers(0, n + 3, 200)
        want = [min((v for v in values[a:b] if v >= y), default=-1) for a, b, y in zip(low, high, x)]
        assert tree.successor(low, high, x, -1).tolist() == want


def test_op11_by_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, "  ".join(made_words(rng)) + rng.choice(["", "\n", " é x"])) for i in range(150)]
    rows += [(None, None), (500, ""), (501, " \t\n"), (502, "a " * 30_000), (502, "a " * 30), (503, None), (504, "Aa aA " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in Q.op11_periodic_runs(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    want = {}
    for i, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        n, h = len(words), zlib.crc32(("" if i is None else str(i)).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = [(0, n, 1)] if n > 9000 else brute_runs(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else None
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        line = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want.setdefault(i, []).append((len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest(line), digest(" ".join(w for k, w in enumerate(words) if k not in gone))))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    runs = periodic.word_runs(df).filter("doc_id = 502").orderBy("length").collect()
    assert [(r.start, r.length, r.period) for r in runs] == [(0, 30, 1), (0, 30_000, 1)]
    plain = periodic.collapse_runs(df.filter("doc_id in (502, 504)")).orderBy("doc_id", "length").collect()
    assert [r.collapsed for r in plain] == ["a", "a", "Aa aA"] and plain[0].runs == "0,30,1\n"
    assert periodic.collapse_runs(df.limit(0)).count() == 0 == periodic.word_runs(df.limit(0)).count()


def brute_links(rows, threshold=0.98):
    """{row: (links, component)} of rows (id, vector, group)."""
    fine = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None and g is not None for i, v, g in rows]
    linked = np.zeros((len(rows),) * 2, bool)
    for a in range(len(rows)):
        for b in range(a):
            if fine[a] and fine[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                linked[a, b] = linked[b, a] = x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold
    own = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            own[a] = min([own[a], *(own[b] for b in np.flatnonzero(linked[a]))])
    return [(int(linked[a].sum()), min(rows[b][0] for b in range(len(rows)) if own[b] == own[a]) if fine[a] else rows[a][0]) for a in range(len(rows))]


@pytest.mark.parametrize("tile", [3, 1024])
def test_op12_by_brute_force(spark, monkeypatch, tile):
    rng = np.random.default_rng(tile)
    monkeypatch.setattr(vectorjoin, "TILE", tile)
    rows = []
    for g, dims in ((1, 16), (2, 16), (None, 16), (3, 5)):
        centres = rng.standard_normal((6, dims))
        for k in range(60):
            spread = rng.choice([0.02, 0.05, 0.1, 0.13])
            rows.append((int(rng.integers(0, 1000)), (centres[k % 6] * rng.uniform(0.1, 50) * (1 if k % 7 else -1) + 0 + spread * rng.standard_normal(dims) * 0 + spread * np.linalg.norm(centres[k % 6]) / np.sqrt(dims) * rng.standard_normal(dims)).tolist(), g))
    rows += [(2000 + i, rows[0][1], 1) for i in range(40)]  # copies
    rows += [(5, [0.0] * 16, 1), (6, None, 1), (7, [], 1), (8, [1.0, None], 1), (9, [float("nan"), 1.0], 1), (10, [float("inf")], 1), (None, rows[0][1], 1), (11, rows[0][1][:8], 1), (11, rows[0][1][:8], 1), (12, [1e300, 1e300], 1), (13, [1e-300, 1e-300], 1), (14, [-0.0, 2.0], 1), (15, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("links", F.lit("clash")).withColumn("h", F.lit(1))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectorjoin.near_vectors(df).collect()), key=str)
    want = sorted(((i, n, c, i == c) for (i, _, _), (n, c) in zip(rows, brute_links(rows))), key=str)
    assert got == want and sum(n for _, n, _, _ in want) > 2000
    assert vectorjoin.near_vectors(df.limit(0)).count() == 0


def test_pairs_at_the_threshold_are_decided_exactly(spark):
    """Pairs within the rounding of the threshold, on both sides of it."""
    rows = []
    for i, c in enumerate((0.98 - 1e-3, 0.98 - 1e-9, 0.98 - 1e-13, 0.98 + 1e-13, 0.98 + 1e-9, 0.98 + 1e-3)):
        x, y = np.zeros(32), np.zeros(32)
        x[i] = 1
        y[i], y[i + 10] = c, np.sqrt(1 - c * c)
        rows += [(2 * i, x.tolist(), 1), (2 * i + 1, y.tolist(), 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectorjoin.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: x for (i, _, _), x in zip(rows, brute_links(rows))} and sorted(n for n, _ in got.values()) == [0] * 6 + [1] * 6


def cheapest(signature):
    """(cost, audit) by a search over all edits; a signature of (role's first letter, fault)."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(signature) and last in ("", "a"):
            return cost, audit
        for r in "ua":
            if r in follows[last]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, r))
        if i < len(signature):
            role, fault = signature[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if role and role in follows[last]:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, role))
                for r in "ua":
                    if r in follows[last]:
                        heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, r))
    raise AssertionError


def letters(signature):
    return "".join("x" if f in ("blank", "duplicate") else (r if r in ("s", "u", "a") else "o").upper() if f == "truncated" else r if r in ("s", "u", "a") else "o" for r, f in signature)


def test_automaton_shares_endings():
    rng = random.Random(1)
    signatures = [[(rng.choice(["s", "u", "a", "t", ""]), rng.choice(["", "", "", "truncated", "blank"])) for _ in range(rng.randint(0, 9))] for _ in range(400)]
    signatures += [[("u", ""), ("a", "")] * 300, [("a", "")] * 50]
    told = sorted({letters(s): s for s in signatures}.items(), key=lambda x: x[0][::-1])
    automaton = dialogue.Automaton()
    for text, signature in told:
        assert automaton.read(text) == cheapest(signature), text
    # Each distinct ending was made once.
    assert automaton.made == len({text[i:] for text, _ in told for i in range(len(text))})


def test_op13_by_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for c in [*range(120), None]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([t, t, t, t + 2, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "uncle"]), rng.choice(["Fine.", "Well then", "What?! ", "", " \t", None, "Fine.", "é!\n", f"text {t}."])))
    rows += [(900, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(700)]
    rows += [(901, 0, "user", "Once."), (901, 0, "user", "Once.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("head", F.lit("clash")).withColumn("audit", F.lit(1))
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r)[1:] for r in Q.op13_dialogue_repair(spark, str(tmp_path)).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == c):
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            after += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
        digest = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r)))
        seen, signature, many = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for _, role, text in after:
            s = text.strip(SPACES)
            fault = "blank" if not s else "duplicate" if (role, text) in seen else "" if s[-1] in ".!?" else "truncated"
            seen.add((role, text))
            many[fault] += 1
            signature.append((role[:1], fault))
        cost, audit = cheapest(signature)
        turns = [t for t, _, _ in after if t is not None]
        out, at, last = [], 0, ""
        for edit in audit:
            fits = "assistant" if last == "u" else "user"
            if edit == "I":
                out.append(f"{fits}:")
            else:
                role, text = after[at][1:]
                at += 1
                if edit == "D":
                    continue
                out.append(f"{fits if edit == 'R' else role}:{text}")
            last = out[-1][0]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(signature, signature[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        want[c] = (gaps, many["blank"], many["duplicate"], many["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    assert got == want
    repair = dialogue.repair(df)
    lines = {}
    for r in repair.rows().orderBy("conv_id", "place").collect():
        assert r.place == len(lines.setdefault(r.conv_id, []))
        lines[r.conv_id].append(r.role[:1])
    for roles in lines.values():
        assert re.fullmatch("s?(ua)+", "".join(roles))
    assert dialogue.repair(df.limit(0)).digests().count() == 0


def test_common_keys_are_spread(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)], "id long, key string")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("most"))
    got = common.join_spread(rows, groups, ["key"], "n")
    assert got.count() == 3000 and got.filter("key = 'hot'").select("most").distinct().count() == 1


def test_tables_leave_no_shuffle_files(spark, monkeypatch):
    kept, seen, write = spark.conf.get(scratch.CLEANUP), [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: (seen.append(spark.conf.get(scratch.CLEANUP)), write(self, path))[1])
    env = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {f for f in env.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f.rsplit("/", 1)[-1]}
    was = names()
    df = spark.range(20_000).groupBy((F.col("id") % 500).alias("k")).count()
    assert sorted(r["count"] for r in common.materialize(df).collect()) == [40] * 500
    assert not names() - was
    assert seen == ["true"] and spark.conf.get(scratch.CLEANUP) == kept


def test_positions_meet_the_states_once(spark):
    """The positions of two words are read once for both results of their join, and scores are those of a plain look-up."""
    rng = random.Random(5)
    states = {ctx: (rng.randint(1, 9) / 10, {s: rng.randint(1, 9) / 10 for s in rng.sample(range(20), 4)}) for ctx in rng.sample(range(60), 40)}
    table = spark.createDataFrame([(k, 5, v[0], list(v[1]), list(v[1].values())) for k, v in states.items()], "ctx long, n long, share double, sym array<int>, p array<float>")
    rows = [(i, -1, rng.randrange(60), rng.randrange(20), 0.25, 0.0, -1.5) for i in range(200)]
    rows += [(i, rng.randrange(60), rng.randrange(60), rng.randrange(20), 0.0, 0.0, -1.5) for i in range(200, 400)]
    rows += [(i, rng.randrange(60), -1, rng.randrange(20), 0.0, 0.5, -1.5) for i in range(400, 600)]
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    tail = spark.createDataFrame(rows, "rid long, two long, one long, sym int, passed float, tail float, root float")
    got = {r.rid: r.s for r in suffixtree.looked_up(tail.mapInArrow(count, tail.schema), table).collect()}
    assert read.value <= 2 * len(rows)
    for rid, two, one, sym, passed, rest, root in rows:
        want = None
        for at in (two, one):
            if at >= 0 and want is None and at in states:
                share, p = states[at]
                if sym in p:
                    want = passed + np.log10(np.float32(p[sym])) - root
                else:
                    passed += np.log10(share)
        assert got[rid] == pytest.approx(passed + rest if want is None else want, abs=1e-5)
