"""Structure repair, periodic runs and exact top-k against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sieveworks.llm import periods, queries, repair, topk

SMALL = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def plain_shortest(symbols):
    """Least (cost, labels) of all edit sequences, by trying them."""
    best = (2 * len(symbols) + 1, "~")

    def go(i, cost, labels, roles, inserted):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(symbols) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, labels))
        if inserted < 3:
            for r in "ua":
                go(i, cost + 5, labels + "I", roles + r, inserted + 1)
        if i < len(symbols):
            more = 5 if symbols[i].isupper() else 0
            go(i + 1, cost + 2, labels + "D", roles, 0)
            if symbols[i] != "-":
                for label, role, c in [("K", symbols[i].lower(), 0), ("R", "u", 1), ("R", "a", 1)]:
                    go(i + 1, cost + c + more, labels + label, roles + role, 0)

    go(0, 0, "", "", 0)
    return best


def test_shortest_against_all_paths():
    rng = random.Random(3)
    words = ["".join(w) for n in range(4) for w in itertools.product("suaoSUA-", repeat=n)] + ["".join(rng.choices("suaoSUAO-", k=5)) for _ in range(150)]
    for w in words:
        cost, path = repair.shortest(w)
        assert (cost, "".join(label for label, _ in path)) == plain_shortest(w), w


def plain_repair(rows):
    """The contract's columns of one conversation, from its damaged rows in order; a least repair by prefixes (cost, labels, roles)."""
    seen, faults = set(), []
    for _, role, text in rows:
        visible = text.strip(BLANK)
        faults.append("b" if not visible else "d" if (role, text) in seen else "" if visible[-1] in ".!?" else "t")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def insert(ways):
        for _ in range(3):
            for at, (cost, labels, said) in list(ways.items()):
                for r, name in (("u", "user"), ("a", "assistant")):
                    if (at, r) in step:
                        new = (cost + 5, labels + "I", [*said, name + ":"])
                        to = step[at, r]
                        if to not in ways or new[:2] < ways[to][:2]:
                            ways[to] = new
        return ways

    ways = insert({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for at, (cost, labels, said) in ways.items():
            options = [(at, cost + 2, "D", said)]
            if fault not in ("b", "d"):
                more = 5 if fault == "t" else 0
                if (at, role[:1]) in step:
                    options.append((step[at, role[:1]], cost + more, "K", [*said, f"{role}:{text}"]))
                options += [(step[at, r], cost + 1 + more, "R", [*said, f"{name}:{text}"]) for r, name in (("u", "user"), ("a", "assistant")) if (at, r) in step]
            for to, c, label, now in options:
                if to not in after or (c, labels + label) < after[to][:2]:
                    after[to] = (c, labels + label, now)
        ways = insert(after)
    cost, labels, said = min((ways[g] for g in ("", "a") if g in ways), key=lambda w: w[:2])
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in "bdt"), illegal, cost, labels, hashlib.sha256("\n".join(said).encode()).hexdigest())


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            one = (turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
            own += [one] * (2 if h == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, own in out.items()}


ODD_TURNS = (
    [(None, 1, "user", "Hi."), (None, None, None, None), (None, 2, "assistant", "Yes."), (5, None, "user", "a."), (5, None, "user", "a."), (6, 1, "", ""), (6, 9, "tool", "x!  \n")]
    + [(7, i, random.Random(i).choice(["system", "user", "assistant", "User", None]), random.Random(i).choice(["Go.", "go", "", " \t", "Why?", "x" * 5000, None])) for i in range(400)]
    + [(8, 3, "user", "Same.")] * 50
    + [(100 + i, j, ["user", "assistant"][j % 2], f"Text {j % 3}.") for i in range(60) for j in range(8)]
)


def test_repair_against_plain_version(spark, monkeypatch):
    from sieveworks.llm import queries as q

    rows = [tuple(r.values()) for r in pq.read_table(f"{SMALL}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()] + ODD_TURNS
    random.Random(2).shuffle(rows)
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, cost string")
    monkeypatch.setattr(q, "table", lambda *_: turns)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = {r["conv_id"]: tuple(r[c] for c in names) for r in queries.op12_repair(spark, "").collect()}
    assert got == {c: plain_repair(own) for c, own in plain_damage(rows).items()}
    assert any(not own for own in plain_damage(rows).values()) or (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) == plain_repair([])
    assert repair.repair(turns.limit(0)).count() == 0


def plain_runs(words, least=6, times=4):
    """Every maximal stretch of every period, kept where no smaller period has it."""
    n, found = len(words), {}
    for q in range(1, n + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, size, q) for (s, size), q in found.items())


def plain_cycled(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def plain_row(doc_id, text):
    words = plain_cycled(doc_id, text)
    runs = plain_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *tail, digest("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_words_against_every_stretch():
    rng = random.Random(9)
    for _ in range(300):
        words = [rng.choice("abcd"[: rng.randint(1, 4)]).encode() for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            cycle = [rng.choice("abcdefgh").encode() for _ in range(rng.randint(1, 5))]
            words[(at := rng.randint(0, len(words))) : at] = (cycle * 9)[: rng.randint(0, 30)]
        assert periods.runs_of(words) == plain_runs(words)
        assert periods.runs_of(words, 3, 2) == plain_runs(words, 3, 2)
    assert periods.runs_of([b"x"] * 30_000) == [(0, 30_000, 1)]
    many = [b"%d" % (i % 7000) for i in range(30_000)]
    assert periods.runs_of(many) == [(0, 30_000, 7000)]


def test_periods_against_plain_version(spark, monkeypatch):
    from sieveworks.llm import queries as q

    table = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in table if len(r["text"] or "") < 6000]
    rows += [(None, "a b " * 20), (7, None), (7, ""), (7, " \n\t "), (7, "go go go go go go"), (8, "x\x1cy " * 9 + "é é " * 9), (9, "word " * 3000), (9, "word " * 3000)]
    rows += [(i, " ".join(f"w{j}" for j in range(i % 90))) for i in range(1_000_000, 1_000_300)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, runs int")
    monkeypatch.setattr(q, "table", lambda *_: docs)
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    key = lambda r: tuple((x is None, x) if x is not None else (True, 0) for x in r)
    got = sorted((tuple(r[c] for c in names) for r in queries.op13_periods(spark, "").collect()), key=key)
    assert got == sorted((plain_row(*r) for r in rows), key=key)
    assert sum(r[1] > 0 for r in got) > 20
    with pytest.raises(ValueError):
        periods.detect(docs, keep=("runs",))
    assert periods.detect(docs.limit(0)).count() == 0


def plain_topk(rows, asked, k=5):
    usable = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(usable):
        if asked(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), c, m) for m, (c, b) in enumerate(usable) if m != n)[:k]
            out += [(q, rank, c, -s) for rank, (s, c, _) in enumerate(scored, 1)]
    return sorted(out)


def check_topk(spark, rows, kind="double", **more):
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, score string")
    got = topk.search(frame, F.col("vec_id") % 50 == 0, **more)
    assert [f.simpleString() for f in got.schema.fields] == ["query_id:bigint", "rank:int", "vec_id:bigint", "score:bigint"]
    assert sorted(map(tuple, got.collect())) == plain_topk(rows, lambda i: i % 50 == 0)


@pytest.mark.parametrize("most_rows", [topk.MOST_ROWS, 97])
def test_topk_against_all_pairs(spark, most_rows):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.125, (700, 24)).astype(np.float32).astype(float)
    x[300:500] = x[10]  # a hot vector: ties go to the smaller id
    x[500:520] = x[50] + rng.normal(0, 0.01, (20, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(None, [1.0] * 24), (700, None), (750, [float("nan")] * 24), (800, [0.1, None]), (850, [float("inf")] + [0.0] * 23), (900, []), (950, [0.0] * 24), (1000, [0.5, -0.5]), (1050, [0.1] * 30)]
    check_topk(spark, rows, most_rows=most_rows)


def test_topk_odd_tables(spark):
    check_topk(spark, [])
    check_topk(spark, [(0, [1.0, 2.0])])
    check_topk(spark, [(0, [1.0]), (50, [2.0]), (3, [-1.0])])
    check_topk(spark, [(i % 60, [float(i % 7), 1.0]) for i in range(180)])  # ids that repeat
    check_topk(spark, [(i, [1e6 * (i % 9 - 4), 3e6, -1e5 * i]) for i in range(120)])
    check_topk(spark, [(i, [0.0, 0.0]) for i in range(120)])


def test_topk_stops_on_proof():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(0, 0.125, (4000, 32))).astype(np.int64)
    x[2000:2010] = x[7]
    ids = np.arange(4000)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(4000, np.int32)), pa.array(ids), pa.array(ids), pa.array(x.tolist(), pa.list_(pa.int64()))], names=["shard", "row", "vec_id", "v"])
    parts = [tuple(r) for b in topk._index(iter([batch])) for r in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True)]
    shard = topk.Shard(parts, 5)
    places, scores = shard.search(7, x[7])
    assert places.tolist() == [2000, 2001, 2002, 2003, 2004] and set(scores.tolist()) == {int(x[7] @ x[7])}
    assert shard.looked < shard.sizes.sum() / 3, "the query stops before all promising postings are read"
