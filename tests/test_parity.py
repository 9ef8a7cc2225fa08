"""Rules of text, evidence, sampling and budgets on hand-made cases and against plain Python."""

import hashlib
import html
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scoring as S
from corpusloom.functions import text as T
from corpusloom.operators import corpus, graph, evaluation, evidence, explorer, tags
from corpusloom.sources import store, tables


def each(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", f(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


def test_folding_and_fingerprints(spark):
    texts = ["Straße ＡＢＣ ﬁn", "ABC def", "> quoted line\nsaid HTTP://x.org/a?b WWW.y.z end", "Ｗｉｄｅ １２", "", None, "İstanbul ΣΑΣ", "½ cup"]
    assert each(spark, texts[:2] + texts[3:], T.casefold) == [None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in texts[:2] + texts[3:]]
    assert each(spark, texts, T.for_fingerprint)[:4] == ["strasse abc fin", "abc def", "said end", "wide 12"]
    assert each(spark, ["ＡＢＣ def", "abc DEF!"], S.content_id)[0] == hashlib.sha256(b"abc def").hexdigest()[:16]


def test_simhash_against_python(spark):
    def by_hand(text):
        words = "".join(c if c.isalnum() else " " for c in unicodedata.normalize("NFKC", text).casefold()).split()
        grams = words if len(words) <= 2 else [" ".join(words[i : i + 2]) for i in range(len(words) - 1)]
        sums = [0] * 64
        for g in grams:
            v = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big")
            sums = [s + (1 if v >> b & 1 else -1) for b, s in enumerate(sums)]
        return sum(1 << b for b, s in enumerate(sums) if s > 0)

    rng = random.Random(2)
    texts = ["", "one", "one two", "one two three", *(" ".join(rng.choice(["a", "be", "Sea", "Größe", "x1"]) for _ in range(rng.randint(1, 60))) for _ in range(40)), "long " * 40000]
    got = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.fingerprint % (1 << 64) for r in S.simhash(got, "doc_id").collect()} == {i: by_hand(t) for i, t in enumerate(texts)}
    assert S.simhash(spark.createDataFrame([(1, None)], "doc_id long, text string"), "doc_id").first().fingerprint == 0


@pytest.mark.parametrize(("bits", "blocks", "crowd"), [(12, 3, None), (12, 3, 7), (12, 3, 300), (11, 3, None), (5, 2, None), (12, 4, 9), (0, 2, None)])
def test_near_pairs_by_flipped_blocks(spark, bits, blocks, crowd):
    """Every pair within the distance, once; also where keys are crowded and split. Only the signed bit differs in some."""
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(40)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 20))) for p in prints] + prints[:5] + [prints[0] ^ 1 << 63, prints[1] ^ 0b1111, prints[1] ^ 0b1111 << 30]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    least = {}
    for i, p in enumerate(prints):
        least.setdefault(p, i)
    want = sorted((a, b, (p ^ q).bit_count()) for p, a in least.items() for q, b in least.items() if a < b and (p ^ q).bit_count() <= bits)
    df = spark.createDataFrame([*enumerate(signed), (None, 5), (999, None)], "doc_id long, fingerprint long")
    got = graph.near_pairs(df, bits=bits, blocks=blocks, crowd=crowd)
    assert sorted((r.a, r.b, r.distance) for r in got.collect()) == want
    assert "Cartesian" not in got._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert graph.near_pairs(df.where("1 = 0"), bits=bits, blocks=blocks).count() == 0


@pytest.mark.parametrize("small", [1 << 18, 5, 0])
def test_greedy_pass_is_that_in_order(spark, small, monkeypatch):
    """Random graphs, hubs and a chain of ten thousand; settled by tasks, by rounds, and by both. A chain takes few rounds."""
    rng = random.Random(7)
    pairs = {tuple(sorted(rng.sample(range(120), 2))) for _ in range(90)} | {(200, i) for i in range(201, 230)} | {(i, 230) for i in range(201, 230)}
    if small != 5:
        pairs |= {(1000 + i, 1001 + i) for i in range(10_000)}
    near, want = {}, {}
    for a, b in pairs:
        near.setdefault(b, []).append(a)
    nodes = sorted({x for p in pairs for x in p} | {500})
    for b in nodes:
        want[b] = min((a for a in near.get(b, []) if want[a] == a), default=b)
    rounds = []
    keep = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: rounds.append(1) or keep(df))
    df = spark.createDataFrame([(x,) for x in nodes], "doc_id long")
    got = graph.first_accepted(df, spark.createDataFrame(sorted(pairs), "a long, b long").union(spark.createDataFrame([(3, 3)], "a long, b long")), small=small)
    assert {r.doc_id: r.root for r in got.collect()} == want
    assert len(rounds) < 60


def test_emoji_and_keywords(spark):
    texts = ["⭐⭐ ok", "© nice", "a‍b c", "plain text é — “x”", "✈️", "1 2 3 #"]
    assert each(spark, texts, T.has_emoji) == [True, True, True, False, True, False]
    terms = ["straße", "größe", "size chart", "size", "fit"]
    texts = ["Die STRASSE, die Straße", "GRÖSSE Größe größer", "Size chart, size-chart size", "fité fit_x FIT", "éfit fit9 (fit)"]
    assert each(spark, texts, lambda c: T.keyword_hits(c, terms)) == [1, 1, 3, 1, 1]
    assert len(T.STOPWORDS) == len(set(T.STOPWORDS)) == 113
    assert each(spark, ["You cant just SHOULD do the thing twice", "don't 3rd x²"], T.content_word_count) == [2, 4]


def test_clean_text(spark):
    raw = ["&amp;gt; caf&eacute; &#8377;99 &#x41;", "a<BR/>b<p class='x'>c</p>d", "waist < 30 inches > useless", "a b\r\nc\rd", "x​y \t\t z\n  \n \n\n\nw  ", "AT&T", None, ""]
    assert each(spark, raw, T.clean_text) == ["> café ₹99 A", "a\nbc\nd", "waist < 30 inches > useless", "a\nb\nc\nd", "xy z\n\nw", "AT&T", None, ""]
    names = list(html.entities.html5)[:200]
    assert each(spark, [f"&{n};x" for n in names if n[-1] != ";"], T.unescape) == [html.unescape(f"&{n};x") for n in names if n[-1] != ";"]


def test_dates(spark):
    now = F.lit("2024-06-15 12:00:00").cast("timestamp")
    said = {"Just now": "2024-06-15 12:00:00", "posted a week  ago": "2024-06-08 12:00:00", "2 months ago": "2024-04-15 14:52:48", "Sept 3, 2023": "2023-09-03 00:00:00", "3 Mar 2024.": "2024-03-03 00:00:00", "31/01/2024": "2024-01-31 00:00:00", "01/31/2024": "2024-01-31 00:00:00", "2024-02-30": None, "2024-03-01T10:00:00Z": "2024-03-01 10:00:00", "2024-03-01T10:00:00+05:30": "2024-03-01 04:30:00", "": None, "soon": None}
    assert each(spark, list(said), lambda c: T.parse_date(c, now).cast("string")) == list(said.values())


def test_contained_quotes(spark):
    """Quotes of any length, from the middle of words on, against a plain search."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(30)] + [(90, None), (91, "")]
    quotes = [(0, "alpha beta"), (1, "ta gam"), (2, ""), (3, None), (4, "missing here not"), (5, "ALPHA  beta")]
    for k in range(6, 40):
        text = docs[rng.randrange(30)][1]
        at = rng.randrange(len(text) - 5)
        quotes.append((k, text[at : at + rng.randint(3, 90)]))
    flat = lambda t: " ".join((t or "").lower().split())
    want = {(q, d) for q, x in quotes for d, t in docs if flat(x) and t is not None and flat(x) in flat(t)}
    got = evidence.contained(spark.createDataFrame(quotes, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r.item_id, r.doc_id) for r in got.collect()) == sorted(want)


def test_movers(spark):
    rows = [(f"l{i:02d}", float(20 - i), float([20, 3, 18, 0, 25, 15, 14, 13, 12, 11, 10, 9][i])) for i in range(12)]
    got = [(r.place, r.label, r.delta) for r in tags.movers(spark.createDataFrame(rows, "label string, score double, genuine_score double")).collect()]
    full = {x[0]: i for i, x in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1)}
    gen = {x[0]: i for i, x in enumerate(sorted(rows, key=lambda x: (-x[2], x[0])), 1)}
    pool = [x[0] for x in rows if (full[x[0]] <= 10 or gen[x[0]] <= 10) and x[2] > 0]
    moved = sorted((n for n in pool if full[n] != gen[n]), key=lambda n: (-abs(full[n] - gen[n]), full[n], n))
    held = sorted((n for n in pool if full[n] == gen[n]), key=full.get)
    slots = min(2, len(held))
    want = (moved[: 6 - slots] + held[:slots] + moved[6 - slots :] + held[slots:])[:6]
    assert got == [(i, n, full[n] - gen[n]) for i, n in enumerate(want, 1)]
    assert tags.movers(spark.createDataFrame(rows[:1], "label string, score double, genuine_score double")).count() == 0


def test_running_total(spark):
    rng = random.Random(7)
    rows = [(i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    upto = 0
    want = {}
    for k, v in rows:
        upto += v
        want[k] = upto
    assert {r.k: r.s for r in evaluation.running_total(df, order="k", value="v", out="s").collect()} == want



def test_limitations():
    one = explorer.limitations({"by_source": {"a": 3, "b": 0}, "pre": 2, "sampled": True, "tagged": 2, "relevant": 3, "flagged_share": 0.25, "ranked": False})
    assert one[0].startswith("The analyzable corpus is a-only") and "a has 3 of 3 analyzable documents (100%)." in one and "b contributed no analyzable document." in one
    assert any("2 of 3" in x for x in one) and any("25%" in x for x in one) and one[-1] == "No themes have been ranked."
    assert explorer.limitations({}) == ["Tags are a machine's; how many are wrong has not been measured."]


def test_store_rules(spark, tmp_path):
    rows = [("a", "s", "1", "t", None), ("a", "s", "2", "t", "b"), ("c", "s", "1", None, "zz"), ("b", "s", "3", "t", None)]
    df = spark.createDataFrame(rows, "doc_id string, source string, source_native_id string, text string, is_duplicate_of string")
    assert {r.rule: r.n for r in store.violations(df, "documents").collect()} == {"text is null": 1, "doc_id repeats": 1, "source, source_native_id repeats": 1, "is_duplicate_of is not in documents": 1}
    assert store.violations(df.where("doc_id = 'b'"), "documents").count() == 0
    assert store.open_table(spark, str(tmp_path), "doc_tags").count() == 0 and store.read_cues(spark, str(tmp_path / "none.yaml")) == {}


def test_manual_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"documents": [{"id": "1", "text": "x"}, {"id": "2", "text": " "}]}')
    (tmp_path / "b.jsonl").write_text('{"id": "3", "body": "y", "date": "2024"}\n\n{"id": "4", "text": "z"}\n')
    (tmp_path / "c.json").write_text("[not json")
    (tmp_path / "d.json").write_text('{"id": "5", "text": "one\\nobject"}')
    (tmp_path / "README.json").write_text('{"id": "6", "text": "no"}')
    assert sorted((r.native_id, r.text, r.created) for r in tables.read_manual(spark, str(tmp_path)).collect()) == [("1", "x", None), ("3", "y", "2024"), ("4", "z", None), ("5", "one\nobject", None)]
    assert [r.file.rsplit("/", 1)[1] for r in tables.bad_manual(spark, str(tmp_path)).collect()] == ["c.json"]


def test_budgets():
    assert explorer.overhead_tokens("x" * 9, "{}") == 4 and explorer.input_budget(8000, 3000, 1500) == 5000 and explorer.input_budget(3000, 3000, 1500) == 1500
