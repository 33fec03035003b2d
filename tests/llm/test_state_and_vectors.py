"""Operators of expiring windows, near-duplicate vectors and vector codes, against brute force."""

import datetime as dt
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest

from casewise.llm import click_windows, heap_codes, rotated_codes, sql

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, hour string, n long"
START = dt.datetime(1969, 12, 20)


def click_rows(n=160, seed=3, heavy=0):
    """Rows with nulls, repeats, equal hours and times before 1970; ``heavy`` more rows of one click."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        click = rng.choice([None, -4, 0, *range(40)])
        at = None if rng.random() < 0.04 else START + dt.timedelta(hours=rng.randint(0, 1500), minutes=rng.randint(0, 59))
        rows.append((click, rng.choice([None, at]), at, rng.choice([None, 1, 2]), rng.choice([None, "", "a|b"]), rng.choice([None, 1.005, -0.3, 1e9]), rng.choice([None, "{}", "x" * 3000]), "h", i))
    rows += [(8, None, START + dt.timedelta(hours=rng.randint(0, 900)), i % 7, "k", float(i % 3), None, "h", i) for i in range(heavy)]
    return rows + rows[:9]


def windows(rows, batches=12):
    copies = []
    for click, ts, at, client, kind, value, props, *_ in rows:
        if click is None or at is None:
            continue
        micros = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        text = lambda x: "" if x is None else str(x)
        cents = "" if value is None else math.floor(100 * value + 0.5)
        own = f"{text(client)}|{text(kind)}|{cents}|{'' if ts is None else micros(ts)}|{text(props)}"
        for j in range(max(0, int(math.fmod(click, 3))) + 1):
            c = zlib.crc32(f"{click}:{j}".encode())
            hour = micros(at) // 3_600_000_000 + 6 * j * (c % 10)
            copies.append((click, hour, hashlib.sha256(f"{own}|{c % 3}".encode()).hexdigest(), hour + c // 10 % 200))
    if not copies:
        return []
    low, high = min(c[3] for c in copies), max(c[3] for c in copies)
    held, out, seen = {}, [], None
    for batch in range(batches):
        now = [c for c in copies if (c[3] - low) * batches // (high - low + 1) == batch]
        for click, hour, own, _ in sorted(c for c in now if not batch or seen is None or c[1] >= seen - 48):
            w = held.get(click)
            if w is None or hour > w[0] + 72:
                if w:
                    out.append((click, w[0], batch, *w[1:]))
                held[click] = [hour, 0, 0, 0, own]
            else:
                w[1] += 1
                if own != w[4]:
                    w[2] += 1
                    w[3] += zlib.crc32(own.encode())
        seen = max([c[1] for c in now] + ([] if seen is None else [seen]), default=None)
        for click in [k for k, w in held.items() if batch == batches - 1 or (seen is not None and w[0] + 72 < seen - 48)]:
            w = held.pop(click)
            out.append((click, w[0], batch, *w[1:]))
    return sorted(out)


def test_click_windows_agree_with_brute_force_and_sql(spark, tmp_path):
    rows = click_rows()
    clicks = spark.createDataFrame(rows, CLICKS)
    got = sorted(tuple(r) for r in click_windows.deduplicate_clicks(clicks).collect())
    assert got == windows(rows) and any(w[4] for w in got) and len({w[2] for w in got}) > 6
    db = duckdb.connect()
    clicks.write.parquet(str(tmp_path / "clicks"))
    db.execute(f"create view clicks as select * from '{tmp_path}/clicks/*.parquet'")
    assert sorted(db.sql(sql.CLICK_WINDOWS).fetchall()) == got


def test_heavy_clicks_are_summed_up_without_loss(spark):
    rows = click_rows(40, seed=5, heavy=400)
    clicks = spark.createDataFrame(rows, CLICKS)
    got = sorted(tuple(r) for r in click_windows.deduplicate_clicks(clicks, batches=4, heavy=50).collect())
    assert got == windows(rows, 4)


def test_executors_give_heap_back_between_starts(spark, monkeypatch):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    collections = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName() and "Concurrent" not in b.getName())
    calls, shrink = [], click_windows.shrink_heaps

    def counted(session):
        before = collections()
        shrink(session)
        calls.append(collections() - before)

    monkeypatch.setattr(click_windows, "shrink_heaps", counted)
    rows = click_rows(60, seed=9)
    got = click_windows.deduplicate_clicks(spark.createDataFrame(rows, CLICKS), batches=5)
    assert sorted(tuple(r) for r in got.collect()) == windows(rows, 5)
    assert len(calls) == 2 and all(n > 0 for n in calls)


def test_no_clicks_no_windows(spark):
    none = spark.createDataFrame([(None, None, None, 1, "k", 1.0, "", "h", 1)], CLICKS)
    assert click_windows.deduplicate_clicks(none).collect() == [] and click_windows.deduplicate_clicks(none.limit(0)).columns == [c.split()[0] for c in click_windows.RESULT.split(", ")]


VECTORS = "vec_id long, embedding array<double>, label int, code string, n_links long"
ODD = [
    (1, None, 1, "x", 0), (2, [], 1, "x", 0), (3, [0.0] * 32, 1, "x", 0), (4, [1.0] * 31 + [None], None, "x", 0), (5, [float("nan")] + [1.0] * 31, 1, "x", 0),
    (6, [1.0] * 32, None, "x", 0), (6, [1.0] * 32, None, "x", 0), (7, [2.0] * 32, 1, "x", 0), (None, [1.0] * 32, 2, "x", 0), (8, [1e200] * 32, 2, "x", 0), (9, [-1e-300] * 32, 2, "x", 0), (10, [1.0] * 7, 3, "x", 0),
    (11, [float("inf")] + [0.0] * 31, 3, "x", 0), (12, [1.0] * 7, 3, "x", 0), (6, [-1.0] * 31 + [4.0], None, "x", 0),
]


def clouds(n, seed, dim=32):
    """Vectors around a few centres, so that similarities lie on both sides of the threshold; some repeat."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 12, dim))
    own = centres[rng.integers(0, len(centres), n)] * rng.uniform(0.2, 3, (n, 1))
    x = own + rng.standard_normal((n, dim)) * np.linalg.norm(own, axis=1, keepdims=True) / math.sqrt(dim) * rng.choice([0.05, 0.2, 0.24], (n, 1))
    x[-n // 20 :] = x[: n // 20]
    return [(100 + i, v.tolist(), int(i % 5) if i % 7 else None, "x", 0) for i, v in enumerate(x)]


def near(rows, threshold=0.95):
    unit = {}
    for i, (key, v, *_) in enumerate(rows):
        if key is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            x = np.array(v) / np.abs(v).max()
            unit[i] = x / np.linalg.norm(x)
    links = {i: [j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in unit}
    out = []
    for i, (key, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = None if key is None else min(rows[j][0] for j in seen)
        out.append((key, len(links.get(i, [])), least, key == least))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("block", [2_048, 7])
def test_near_vectors_agree_with_brute_force(spark, block):
    rows = ODD + clouds(500, 2)
    got = rotated_codes.near_vectors(spark.createDataFrame(rows, VECTORS), p=rotated_codes.Near(block_rows=block)).collect()
    want = near(rows)
    found, there = sum(r.n_links for r in got), sum(r[1] for r in want)
    assert there > 2_000 and 0.97 * there <= found <= there
    exact = {r[0]: r for r in want}
    assert all(r.n_links <= exact[r.vec_id][1] for r in got if r.vec_id not in (None, 6))
    assert by_id(tuple(r) for r in got if r.vec_id is None or r.vec_id < 100) == by_id(r for r in want if r[0] is None or r[0] < 100)


def test_tables_promise_their_recall():
    rng = np.random.default_rng(1)
    x = rotated_codes.unit(rng.standard_normal((3_000, 64)))
    tables = rotated_codes.Tables(x, 50_000, rotated_codes.Near())
    assert tables.seen >= 0.985 and abs(np.mean([(tables.rotation.codes(x) >> np.uint64(i)) & np.uint64(1) for i in range(64)]) - 0.5) < 0.02


def test_near_vectors_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert rotated_codes.near_vectors(empty).collect() == [] and heap_codes.code_vectors(empty).collect() == []


def codes(rows, p):
    rows = [(key, label, [math.floor(p.scale * x) for x in v]) for key, v, label, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    rows = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[2])) + [r for r in rows if r[0] is None]
    rows = [r for r in rows if len(r[2]) == len(rows[0][2])]
    d = -(-len(rows[0][2]) // p.positions)
    parts = [[(r[2] + [0] * d * p.positions)[i * d : i * d + d] for i in range(p.positions)] for r in rows]
    books = [[parts[r][i] for r in range(min(p.entries, sum(r[0] is not None for r in rows)))] for i in range(p.positions)]
    apart = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    nearest = lambda: [[min(range(len(books[i])), key=lambda e: (apart(part[i], books[i][e]), e)) for i in range(p.positions)] for part in parts]
    for _ in range(p.rounds):
        now = nearest()
        for i in range(p.positions):
            for e in range(len(books[i])):
                if own := [part[i] for part, code in zip(parts, now, strict=True) if code[i] == e]:
                    books[i][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    now, sums = nearest(), {}
    error = [sum(apart(part[i], books[i][c]) for i, c in enumerate(code)) for part, code in zip(parts, now, strict=True)]
    for r, e in zip(rows, error, strict=True):
        sums[r[1]] = sums.get(r[1], 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return [(r[0], None if r[1] is None else str(r[1]), "".join(f"{c:02x}" for c in code), e, sums[r[1]], digest) for r, code, e in zip(rows, now, error, strict=True)]


def test_codes_agree_with_brute_force(spark):
    rows = [r for r in ODD if r[0] not in (8, 2)] + clouds(300, 4)
    for p in (heap_codes.Coding(entries=20, rounds=4, block_rows=50), heap_codes.Coding(positions=5, entries=3, rounds=2)):
        got = heap_codes.code_vectors(spark.createDataFrame(rows, VECTORS).repartition(3), p=p).collect()
        assert by_id(tuple(r) for r in got) == by_id(codes(rows, p))


def test_codes_of_components_beyond_double_precision(spark):
    rows = [(i, [float(3 ** (i + k)) * (-1) ** k for k in range(32)], i % 2, "x", 0) for i in range(12)]
    p = heap_codes.Coding(entries=4)
    want = [(*r[:3], *(None if e >= 1 << 63 else e for e in r[3:5]), r[5]) for r in codes(rows, p)]
    got = heap_codes.code_vectors(spark.createDataFrame(rows, VECTORS), p=p).collect()
    assert [(r.vec_id, r.code, r.error, r.codebooks_sha256) for r in sorted(got)] == [(r[0], r[2], r[3], r[5]) for r in sorted(want)]


def test_fewer_vectors_than_entries(spark):
    rows = [(3, [0.5] * 16, None, "x", 0), (None, [0.25] * 16, 1, "x", 0)]
    got = sorted(heap_codes.code_vectors(spark.createDataFrame(rows, VECTORS)).collect(), key=str)
    assert {r.code for r in got} == {"00" * 16} and by_id(tuple(r) for r in got) == by_id(codes(rows, heap_codes.Coding()))
