"""Operators 11 to 13 against brute force: suffix arrays, repairs by searching all edits, trees built level by level in one place."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import merkle, queries, repair, suffixes
from test_llm import CLASHES, SCHEMA, docs, nothing, prose  # noqa: F401  (fixtures)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# ---- 11 ----


def test_suffix_order_is_that_of_sorted_suffixes():
    rng = random.Random(3)
    for _ in range(400):
        text, lane = [], []
        for at in range(rng.randint(1, 4)):
            for _ in range(rng.randint(1, 4)):
                s = [0] + [rng.randint(1, rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 12))]
                text, lane = text + s, lane + [at] * len(s)
            text, lane = text + [0], lane + [at]
        unique = [(x, i if x == 0 else 0) for i, x in enumerate(text)]
        want = sorted(range(len(text)), key=lambda i: (lane[i], unique[i:]))
        assert suffixes.suffix_order(np.array(text, np.int16), np.array(lane)).tolist() == want


def removed(rows, length):
    """(id, bytes, removed runs) by a table of all windows."""
    first = {}
    low = lambda i: -(1 << 63) if i is None else i
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, low(i)), low(i))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < low(i):
                gone[p : p + length] = True
        edge = np.flatnonzero(np.diff(np.append(False, gone)))
        out.append((str(i), len(b), [tuple(x) for x in edge.reshape(-1, 2).tolist()], sha(bytes(x for x, g in zip(b, gone, strict=False) if not g))))
    return sorted(out)


def check_removed(df, **more):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = suffixes.remove_repeats(df, **more)
    assert sorted((str(r.doc_id), r.n_bytes, [tuple(x) for x in r.spans], r.kept_sha256) for r in got.collect()) == removed(rows, more.get("length", 50))
    return got


def test_repeats_go(docs, nothing):  # noqa: F811
    got = check_removed(docs)
    assert got.columns == [*[c for c in docs.columns if c != "text"], "n_bytes", "n_removed", "spans", "kept_sha256"]
    assert got.where("n_removed > 0").count() > 3
    assert suffixes.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize(("length", "k", "letters"), [(6, 3, "ab"), (5, 5, "abc"), (12, 4, "aé"), (8, 3, "a"), (50, 16, "ab \n")])
def test_repeats_of_few_letters_go(spark, length, k, letters):
    """Periodic texts, texts that hold one another, crowded and heavy anchors."""
    rng = random.Random(length)
    own = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 20, 60, 200]))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(own)] + [(100 + i, own[rng.randrange(60)][5:] + own[rng.randrange(60)]) for i in range(40)] + [(7, own[9]), (7, own[9]), (None, own[11]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_removed(df, length=length, k=k)


def test_crowded_anchors_go_on_by_window(spark, monkeypatch):
    """An anchor of very many different pieces, and one whose rows outgrow a chunk."""
    monkeypatch.setattr(suffixes, "LANE", 3)
    rng = random.Random(5)
    said = "the same forty byte passage in them all "
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) + said + "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check_removed(df)
    parts = suffixes._settle(50)
    monkeypatch.setattr(suffixes, "_CHUNK", 50)
    t = suffixes._rows([b"k" * 24 + bytes([97 + i % 5]) * 26 for i in range(200)], [0] * 200, [24] * 200, range(200), [0] * 200, [0] * 200, [None] * 200)
    got = [r for b in parts([t.add_column(0, "anchor", pa.array([b"k" * 24] * 200))]) for r in b.to_pylist()]
    assert len(got) == 200 and all(r["size"] == 50 for r in got)
    got.sort(key=lambda r: (r["piece"], r["doc"]))
    b = suffixes._rows(*([r[c] for r in got] for c in suffixes._NAMES))
    again = [r for b in suffixes._settle(50)([b.add_column(0, "anchor", b.column("piece"))]) for r in b.to_pylist()]
    assert {r["doc"] for r in again if r["stop"] is not None} == set(range(5, 200))


def test_heavy_anchors_go_by_window(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HEAVY_SHARE", 1e-9)
    said = prose(4, 12)
    rows = [(i, f"{prose(100 + i, 5)} {said} {prose(500 + i, 5)}") for i in range(400)]
    check_removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))


# ---- 12 ----


def faults(rows):
    seen, kinds = set(), []
    for _, role, text in rows:
        t = text.strip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    return kinds


def searched(rows, kinds):
    """(cost, audit, lines) of the best of all edits with up to two inserts before each row and at the end."""
    best = None
    for keeps in itertools.product(*[["D"] if k in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"] for k in kinds]):
        for n in itertools.product(["", "u", "a", "uu", "ua", "au", "aa"], repeat=len(rows) + 1):
            roles, cost, audit, lines = "", 0, "", []
            for i in range(len(rows) + 1):
                for r in n[i]:
                    roles, cost, audit = roles + r, cost + 2, audit + "I"
                    lines.append(("user" if r == "u" else "assistant") + ":")
                if i == len(rows):
                    break
                e, (_, role, text) = keeps[i], rows[i]
                audit += e[0]
                if e == "D":
                    cost += 3
                    continue
                role = role if e == "K" else "user" if e == "Ru" else "assistant"
                cost += (e != "K") * 2 + (kinds[i] == "truncated")
                roles += role[:1] or "?"
                lines.append(f"{role}:{text}")
            if (best is None or (cost, audit) < best[:2]) and re.fullmatch("(s?(ua)+)?", roles):
                best = (cost, audit, lines)
    return best


def test_weights_are_those_of_all_edits():
    rng = random.Random(1)
    for _ in range(60):
        rows = [(i, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b", " ", "c!"])) for i in range(rng.randint(0, 3))]
        kinds = faults(rows)
        symbols = [(role[:1], k in ("blank", "duplicate"), k == "truncated") for (_, role, _), k in zip(rows, kinds, strict=True)]
        cost, said, lines = searched(rows, kinds)
        got = repair.ended(repair.shortest(symbols))
        assert got == (cost, said)
        assert [f"{r}:{t}" for _, r, t in repair.applied(said, [x[1:] for x in rows])] == lines


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(2)
    rows = []
    for c in [*range(30), None]:
        for turn in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([turn, turn, turn, None, turn * 3]), rng.choice(["user", "assistant", "assistant", "system", "tool", None, ""]), rng.choice(["yes.", "no", "", " \n", None, "what? ", "é!", "x" * 50]), "own"))
    rows += [(77, t, ("user", "assistant")[t % 2], f"said {t % 40}" + "." * (t % 3 > 0), "own") for t in range(300)]
    rows += [(78, 5, "user", "the same.", "own")] * 200
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, run string").repartition(5)


def test_repairs(talks):
    by = defaultdict(list)
    hashed = talks.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(" "))))
    for r in hashed.collect():
        by[r.conv_id].append(((r.turn is not None, r.turn or 0), r.role if r.role is not None else " ", r.th, r.text if r.text is not None else " ", r.turn))
    want = []
    for conv, rows in by.items():
        rows = [(turn, role, text) for _, role, _, text, turn in sorted(rows)]
        kinds = faults(rows)
        symbols = [(role[:1], k in ("blank", "duplicate"), k == "truncated") for (_, role, _), k in zip(rows, kinds, strict=True)]
        cost, said = repair.ended(repair.shortest(symbols))
        turns = [t for t, _, _ in rows if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        lines = "\n".join(f"{r}:{t}" for _, r, t in repair.applied(said, [x[1:] for x in rows]))
        want.append((str(conv), max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, said, sha(lines)))
    tell = lambda df: sorted((str(r.conv_id), r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect())
    assert tell(repair.repair(talks)) == sorted(want)
    assert tell(repair.repair(talks, piece_rows=3)) == sorted(want)
    assert tell(repair.repair(talks, piece_bytes=1)) == sorted(want)
    assert repair.repair(talks.where("false")).count() == 0


def test_repair_query_tells_of_lost_conversations(spark, tmp_path):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "gone."), (5000, 1, None, None), (None, None, "user", "hm")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {lost, 5000, None}
    assert (got[lost].cost, got[lost].audit, got[lost].repaired_sha256) == (0, "", sha(""))


# ---- 13 ----


def grown(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def climbed(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 3
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
        i //= 3
    return out


def manifest(rows, tamper):
    """A row per leaf, by trees held in one place."""
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(f, [r.doc_id, r.source, r.lang, r.n_chars, text])))
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(((r.doc_id is not None, r.doc_id or 0), leaf(r, r.text), leaf(r, tamper(r)), r.doc_id))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grown([x[1] for x in sorted(by[s], key=lambda x: x[:2])]) for s in order}
    crown = grown([trees[s][-1][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for i, (_, h, claimed, doc) in enumerate(sorted(by[s], key=lambda x: x[:2])):
            path = climbed(trees[s], i) + climbed(crown, n)
            for a, b in path:
                claimed = sha(a + claimed + b)
            out.append((str(doc), h, trees[s][-1][0], crown[-1][0], sha("".join(a + b for a, b in path)), claimed, claimed == crown[-1][0]))
    return sorted(out)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest(spark, docs, levels):  # noqa: F811
    own = docs.select("doc_id", "text", "lang", "source", "n_chars", "h", "row", "base")
    rows = [(i, f"text\n{i % 9}" * (i % 4), "en", f"é{i % 7}" if i % 5 else "hot", i) for i in range(150)] + [(3, "x\ny", "de", None, 3), (3, "x\ny", "de", None, 3), (9999, "\n", None, "a lone leaf", None), (4, None, "en", "", 0)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = own.unionByName(more, allowMissingColumns=True).repartition(4)
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle.proofs(merkle.build(df, claimed_text=text, levels=levels), levels=levels)
    tamper = lambda r: r.text.replace("\n", "") if r.text is not None and r.doc_id is not None and r.doc_id % 2 == 0 else r.text
    want = manifest(df.collect(), tamper)
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect()) == want
    assert {x[-1] for x in want} == {True, False}


def test_manifest_of_nothing_and_of_one(spark, nothing):  # noqa: F811
    assert merkle.proofs(merkle.build(nothing)).count() == 0
    one = nothing.union(spark.createDataFrame([(1, "a", "en", "s", 1, *["q"] * len(CLASHES))], SCHEMA))
    (r,) = merkle.proofs(merkle.build(one)).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root == sha("1:11:s2:en1:11:a") and r.proof_sha256 == sha("") and r.verified


@pytest.mark.parametrize("name", ["op11_suffix_array_dedup", "op12_conversation_repair", "op13_merkle_manifest"])
def test_queries_give_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    found = duck.execute(queries.SQL[name])
    at = [[x[0] for x in found.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in found.fetchall())
