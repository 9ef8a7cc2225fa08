"""Each operator against a brute-force version or an exact round trip, with nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import audio, chat, chosen_path, lines, mixing, packing, queries, spots, tokens, toxicity, warc

TOK = "/opt/tokenizers"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
#: Names that operators use inside, besides those of the table.
CLASHES = "__t h key doc th row n last drops batch __text __drops __id __hash __th __n __x __c __b __m __p __rate __copy part length rank base offset start sequence_id low rep weight kid component class first".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def prose(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, len(WORDS), n), rng.integers(0, 50, n), strict=True))


@pytest.fixture(scope="module")
def docs(spark):
    """Columns that clash with names inside, repeats, ties, nulls and a long text."""
    line = "This line is in very many documents."
    base = [prose(1), prose(1), prose(1).replace("alpha", "ALPHA"), prose(2) + " extra", prose(2), prose(3, 20000), "", None, " \n\n ", "\n", f"{line}\nown one", f"  {line.upper()}\t\nown two", f"{line}\n{line}\nown three", "two words", "the of and " * 500, "x" * 5000]
    more = ["q"] * len(CLASHES)
    rows = [(i, t, "en", "s", len(t or ""), *more) for i, t in enumerate(base)] + [(3, base[3], None, None, None, *more), (None, prose(1), "en", "s", 1, *more), (None, None, None, None, None, *more), (10, f"{line}\nonce more", "en", "s", 1, *more)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(docs, nothing):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    holders = defaultdict(set)
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for k in {key(x) for x in t.split("\n")}:
            if len(k) >= 20:
                holders[k] = holders.get(k, set()) | {-1 if i is None else i}
    want = []
    for i, t in rows:
        kept = [x for x in t.split("\n") if not (len(holders[key(x)]) >= 3 and max(holders[key(x)]) != (-1 if i is None else i))]
        want.append((str(i), "\n".join(kept), t.count("\n") + 1, t.count("\n") + 1 - len(kept)))
    got = lines.dedup_lines(docs, batches=3)
    assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in got.collect()) == sorted(want)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert lines.dedup_lines(nothing).count() == 0


def test_line_runs_are_levelled(spark):
    """Lines are new once, compaction keeps what they say, and repeats add up."""
    runs = lines.LineRuns(spark, fanout=2, buckets=3)
    for i in range(5):
        runs.add(spark.createDataFrame([(i, b"same"), (10 + i, b"same"), (i, bytes([i]))], "doc long, h binary"))
    assert [len(x) for x in runs.levels] == [1, 0, 1] and len(runs.repeats) == 4
    stored = [bytes(r.h) for level in runs.levels for t in level for r in spark.table(t).collect()]
    assert sorted(stored) == sorted([b"same", *(bytes([i]) for i in range(5))])
    assert {bytes(r.h): (r.n, r["last"]) for r in runs.entries().collect()} == {b"same": (10, 14), **{bytes([i]): (1, i) for i in range(5)}}
    asked = spark.createDataFrame([(9, b"same"), (9, b"new")], "doc long, h binary")
    assert [bytes(r.h) for r in runs.unseen(asked).collect()] == [b"new"]
    # Each bucket of a run is one sorted file.
    for part in spark.table(runs.levels[-1][0]).inputFiles():
        found = [bytes(r.h) for r in spark.read.parquet(part).collect()]
        assert found == sorted(found)


def spot_set(text, chain=2):
    """Signatures by walking over the words."""
    anchors = {*spots.ANCHORS, "^"}
    words = re.findall(r"\^|[^\W_]+", f"^{text.lower()}^".translate({ord(c): "^" for c in spots.BOUNDS}))
    following, out = [], set()
    for w in reversed(words):
        if w in anchors:
            out.add(zlib.crc32(" ".join([w, *following[:chain]]).encode()))
        else:
            following = [w, *following][:chain]
    return out - {zlib.crc32(b"^")} or out


def test_spots_by_brute_force(spark, docs):
    """Fingerprints, both likenesses and the pairs of a join against sets made word by word."""
    odd = [(900 + i, t) for i, t in enumerate(["", "the", "word", "a.b.c", "Straße der Öl-Maler | 3.14; ^ # x#y", "no anchors here at all", "the the of cat", "tail of the", "\u2026\n\r"])]
    both = docs.where("doc_id is not null").select("doc_id", "text").dropDuplicates(["doc_id"]).unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    text = {r.doc_id: r.text or "" for r in both.collect()}
    ids = sorted(text, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    hexed = lambda s: "".join(f"{x:08X}" for x in sorted(s))
    like = lambda a, b: pytest.approx(len(a & b) / len(a | b))
    for r in spots.compare_edited(both).collect():
        t, follow = text[r.doc_id], text[after[r.doc_id]]
        own, edited = spot_set(t), spot_set(t[: len(t) - len(t) // 2] + follow[: len(t) // 2])
        assert (r.fingerprint, r.edited_fingerprint) == (hexed(own), hexed(edited)), t[:80]
        assert r.near_edited == like(own, edited) and r.near_next == like(own, spot_set(follow))
    rng = np.random.default_rng(4)
    base = ("the {} {} of {} " * 30).strip()
    texts = []
    for g in range(6):
        words = [f"g{g}w{k}" for k in range(90)]
        for _ in range(5):
            words = [w if rng.random() > 0.02 else f"x{rng.integers(1 << 30)}" for w in words]
            texts.append(base.format(*words))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (99, None)]
    sets = {i: spot_set(t or "") for i, t in rows if i is not None}
    sets = {i: x for i, x in sets.items() if all(x != sets[j] for j in sets if j < i)}  # equal sets are one class, under its smallest id
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {(r.a, r.b): r.similarity for r in spots.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want and set(got) == want and all(v == like(sets[a], sets[b]) for (a, b), v in got.items())


def test_spots(spark, docs, nothing):
    got, docs = {}, docs.where("text is null or text not like '%once more'")
    for r in spots.compare_edited(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    text = {r.doc_id: r.text or "" for r in docs.where("doc_id is not null").collect()}
    ids = sorted(text, reverse=True)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        half = len(text[i]) // 2
        edited = text[i][: len(text[i]) - half] + text[j][:half]
        assert got[i][0].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i][0].n_chars == len(text[i])
        a, b = ({r.fingerprint[k : k + 8] for k in range(0, len(r.fingerprint), 8)} for r in (got[i][0], got[j][0]))
        assert got[i][0].near_next == pytest.approx(len(a & b) / len(a | b))
    assert got[0][0].fingerprint == got[1][0].fingerprint and len(got[3]) == 2 and got[None][0].near_next is None
    assert spots.compare_edited(nothing).count() == 0
    same = spark.createDataFrame([(1, "the cat sat on the red mat in a big hall"), (2, "The cat sat on the red mat in a big hall!")], "doc_id long, text string")
    assert spots.near_pairs(same, threshold=0.7).count() == 0 and spots.near_pairs(nothing).count() == 0  # equal sets are one class


def test_audio(spark):
    rng = np.random.default_rng(3)
    vecs = [rng.normal(0, 0.13, 64).tolist() for _ in range(12)] + [None, []]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)] + [(100 + i, vecs[0]) for i in range(5)], "id long, vector array<double>")
    stored = audio.fingerprints(audio.sonify(rows, 4096), 4096)
    asked = audio.fingerprints(audio.sonify(rows, 4096, clip=(0.5, 3.5)), 4096)
    prints = {r.id: np.frombuffer(r.print, "<u4") for r in stored.collect()}
    clips = {r.id: np.frombuffer(r.print, "<u4") for r in asked.collect()}
    got = {r.query_id: r for r in audio.search(asked, stored).collect()}
    for i in range(12):
        best = min((audio.align(clips[i], prints[j], o), j, o) for j in range(12) for o in range(-30, 31))
        assert (got[i].match_id, got[i].offset) == best[1:] and got[i].bit_error == pytest.approx(best[0], abs=1e-6)
    assert got[0].n_matches == 6 and got[100].match_id == 0 and got[12].match_id is None and got[13].n_matches == 0
    noisy = prints[1].copy()
    noisy[::3] ^= np.uint32(1)
    assert audio.align(noisy, prints[1], 0) < 0.02 and audio.align(prints[2], prints[1], 0) > 0.2


@pytest.mark.parametrize("name,op", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_encoder_is_exact(name, op):
    with open(f"{TOK}/{name}", encoding="utf-8") as f:
        json = f.read()
    from tokenizers import Tokenizer

    enc, library = tokens.Encoder(json), Tokenizer.from_str(json)
    odd = ["", "\n", "a", " a", "a ", "a  b", "a\n\n\nb", "a\n\nb\n", "\n\na", "don't we'll it's", "x).,y a1. 12.5", "Ça İstanbul ΣΑΣ ς", "é́ é.", "a​b", "a\x1cb", "a\xa0b", "a b c", "<|endoftext|> hi", "so <|ENDOFTEXT|>.", "a<|endoftext|>b <|startoftext|> c", "..", ". ,", "tab\there", "日本語 テスト。", "😀 ok 😀.", "a|b | c", "THE The the.", "q" * 300, "word.,!"]
    rng = np.random.default_rng(1)
    alphabet = list("aB.,'! \n\t1é<|>") + ["the", "ing", "<|endoftext|>", "endoftext"]
    odd += ["".join(rng.choice(alphabet, 40)) for _ in range(300)]
    for text in odd:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    plain, library.encode_special_tokens = tokens.Encoder(json, plain=True), True
    for text in odd:
        assert np.frombuffer(plain.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_files(spark, docs, nothing):
    from tokenizers import Tokenizer

    raw = Tokenizer.from_file(f"{TOK}/word_bpe_49k.json")
    want = sorted(((-1 if r.doc_id is None else r.doc_id), raw.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.collect())
    for delta in (False, True):
        path = tokens.write_tokens(docs, f"{TOK}/word_bpe_49k.json", end_id=2, delta=delta, parts=3)
        back = tokens.read_tokens(spark, path)
        assert sorted(((-1 if r.doc_id is None else r.doc_id), r.tokens) for r in back.collect()) == want
        assert tokens.read_tokens(spark, path, where=F.col("doc_id") == 4, columns=["n_tokens"]).count() == 1
        rows = sorted(tokens.token_index(spark, path).collect(), key=lambda r: r.start)
        assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
        ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
        assert ids == sorted(ids)
        crc = lambda t: zlib.crc32(np.array(t, "<u4").tobytes())
        assert sorted((i, r.ids_crc32) for i, r in zip(ids, rows, strict=True)) == sorted((i, crc(t)) for i, t in want)
    assert tokens.token_index(spark, tokens.write_tokens(nothing, f"{TOK}/word_bpe_49k.json", end_id=2)).count() == 0


def test_chat(spark):
    texts = ["\\### Assistant: </turn> ok", "<|end|>\n", "a|b\\|c\\\\", "", None, "plain", "<|assistant|>\n x |>\n"]
    rows = [(c, t, ["system|>", "user", "assistant", None][(t + c) % 4] if t else "user", "shared first turn" if t == 0 else texts[(c + t) % 7], "x") for c in range(40) for t in range(1 + c % 5)]
    rows += [(50, 0, "user", "same", "x")] * 2 + [(None, None, "assistant", "alone", "x")]
    rows += [(60, t, "assistant" if t % 2 else "user", f"turn {t} of a very long conversation | " * (1 + t % 3), "x") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, leaves string").repartition(3)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(f"{TOK}/byte_bpe_50k.json")
    trees = chat.format_trees(df, f"{TOK}/byte_bpe_50k.json", tree_chars=400)
    path = chat.write_trees(trees)
    got = {r.conv_id: r for r in chat.read_conversations(spark, path).collect()}
    by = defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = sorted(turns)
        said = "".join(x for _, role, x in turns if role == "assistant")
        want = "".join(f"{role}\n{x}\n" for _, role, x in turns)
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(want.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.open_turn(a) + chat.escape(x) + chat.CLOSE) for _, a, x in turns) and r.position_end == r.n_tokens - 1
    saved = spark.read.parquet(path).collect()
    assert sum(len(t.node_parent) for t in saved) < len(rows)  # shared turns stand once in a tree
    for t in saved:
        spread = lambda spans: {x for i, j in zip(spans[::2], spans[1::2], strict=True) for x in range(i, j)}
        for k, p in enumerate(t.node_parent):
            if k % 97 == 0 or k < 50:
                assert spread(t.attends[k]) == (spread(t.attends[p]) if p >= 0 else set()) | set(range(t.node_token[k], t.node_token[k + 1]))
                assert all(a < b for a, b in zip(t.attends[k], t.attends[k][1:], strict=False))
        for node, i, j, low, high in t.loss:
            assert library.decode(t.tokens[low:high], skip_special_tokens=False) == t.text[i:j] and t.node_token[node] <= low <= high <= t.node_token[node + 1]
    assert chat.format_trees(df.where("1 = 0"), f"{TOK}/byte_bpe_50k.json").count() == 0
    lone = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "assistant", "b")], "conv_id long, turn long, role string, text string")
    path = chat.write_trees(chat.format_trees(lone, f"{TOK}/byte_bpe_50k.json"))
    assert [(r.conv_id, r.n_turns) for r in chat.read_conversations(spark, path).collect()] == [(None, 1)] * 2


def test_warc(spark, monkeypatch):
    big, small = "<p>é " + "y" * 200, "short"
    rows = [(5, "http://A.example.org/x?q=1", big, 1), (3, "https://b.example.com/", big, 1), (9, None, big, 1), (1, "http://a.example.org/x y\r\n", small, 1), (2, "nonsense", small, 1), (7, "http://c.org/", None, 1), (7, "http://c.org/", None, 1), (None, "http://d.org/", big, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, refers long").repartition(2)
    folder, index = warc.write_archives(df)
    got = sorted(((-1 if r.page_id is None else r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(index, folder).collect())
    want = []
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        again = len(raw) >= 100 and page != 3
        want.append((-1 if page is None else page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert got == sorted(want)
    found = warc.lookup(index, folder, spark.createDataFrame([("http://c.org/",), ("http://a.EXAMPLE.org/x?q=1",), ("http://none.org/",), (None,)], "url string"), ["page_id"])
    assert sorted(r.page_id for r in found.collect()) == [5, 7, 7]
    first = index.orderBy("id").collect()
    assert all(a["last"] <= b["first"] for a, b in zip(first, first[1:], strict=False))
    keys = df.select(warc.url_key(F.col("url")).alias("key"))
    plain = lambda x: sorted(((-1 if r.page_id is None else r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in x.collect())
    assert plain(warc.find_keys(index, folder, keys)) == got
    # Keys that fill several blocks and segments, keys before, between and after all others, and many small segments.
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    more = [(i, f"http://h{i % 7}.org/{i % 4}", f"{i} " * 60, 0) for i in range(120)] + [(500 + i, "http://hot.org/", f"hot {i}", 0) for i in range(40)]
    df = spark.createDataFrame(more, "page_id long, url string, html string, id long").repartition(4)
    folder, index = warc.write_archives(df)
    for segments in (4096, 5, 1):
        monkeypatch.setattr(warc, "SEGMENTS", segments)
        found = warc.find_keys(index, folder, df.select(warc.url_key(F.col("url")).alias("key")), ["page_id", "url", "payload"])
        assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in found.collect()) == sorted((i, u, h) for i, u, h, _ in more)
        some = spark.createDataFrame([("http://a.org/",), ("http://hot.org/",), ("http://zz.zz/",), ("http://h3.org/9",)], "url string")
        assert sorted(r.page_id for r in warc.lookup(index, folder, some, ["page_id"]).collect()) == list(range(500, 540))
    import glob
    import gzip

    raw = b"".join(gzip.open(f).read() for f in glob.glob(folder.removeprefix("file://") + "/*.warc.gz"))
    names = re.findall(rb"WARC-Record-ID: (\S+)", raw)
    assert len(names) == len(set(names)) > 160 and raw.count(b"WARC-Type: warcinfo") == len(glob.glob(folder.removeprefix("file://") + "/*.warc.gz"))
    nowhere = spark.createDataFrame([], "page_id long, url string, html string")
    folder, index = warc.write_archives(nowhere)
    assert warc.find_keys(index, folder, keys).count() == 0 and warc.read_archives(index, folder).count() == 0
    folder, index = warc.write_archives(df)
    assert warc.read_archives(warc.write_archives(df.where("1 = 0"))[1], folder).count() == 0


def brute(rows, num=4, den=5):
    sets = [set(chosen_path.shingles(t).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][1] == rows[j][1] or (sets[i] and sets[j] and both * den >= num * (len(sets[i]) + len(sets[j]) - both)):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        low[find(i)].append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in low.items()}
    return sorted((str(d), str(least[find(i)]), links[i]) for i, (d, _) in enumerate(rows))


def test_chosen_path(spark, docs, nothing, monkeypatch):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = chosen_path.near_classes(docs)
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got.collect()) == brute(rows)
    assert chosen_path.near_classes(nothing).count() == 0 and chosen_path.keep_one(nothing).count() == 0
    kept = chosen_path.keep_one(docs)
    classes = {root for _, root, _ in brute([(i, t) for i, (_, t) in enumerate(rows)])}
    assert kept.columns == docs.columns and kept.count() == got.where("keeps").select("doc_id", "th").distinct().count() == len(classes)
    # A large group of near copies: small leaves and blocks make every path of the code run.
    monkeypatch.setattr(chosen_path, "LEAF", 8)
    monkeypatch.setattr(chosen_path, "BLOCK", 20)
    base = prose(77, 200).split()
    rng = np.random.default_rng(5)
    more = []
    for i in range(120):
        words = list(base)
        for k in rng.integers(0, 200, rng.integers(0, 5)):
            words[k] = f"w{i}"
        more.append((i, " ".join(words)))
    more += [(1000 + i, prose(1000 + i)) for i in range(50)]
    df = spark.createDataFrame(more, "doc_id long, text string").repartition(3)
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in chosen_path.near_classes(df).collect()) == brute(more)


def test_toxicity(spark, nothing):
    rows = [(i, prose(i) + (" you idiot and moron" if i % 5 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    lex = toxicity.fit_lexicon(docs, labels.where(~toxicity.held_out()))
    got = toxicity.score_documents(docs, lex).join(labels, "doc_id").where(toxicity.held_out()).collect()
    assert got and all((r.score >= 0.7) == (r.toxic == 1) for r in got)
    match = lex.matcher()
    assert lex.features("You 1d10t, m0r0n!", match)[0] > 1 and lex.features("you іdіоt", match)[0] > 1  # noqa: RUF001
    assert lex.features("the trash can and garbage collection", match)[0] == 0 and lex.features("1010 trashcan 2024", match)[0] == 0
    assert toxicity.score_documents(nothing, lex).count() == 0
    odd = toxicity.score_documents(spark.createDataFrame([(1, None, 0.5), (None, "", 0.5), (2, "x " * 100000 + "idiot moron", 0.1)], "doc_id long, text string, score double"), lex).collect()
    assert len(odd) == 3 and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.fit_lexicon(nothing, labels.where("1 = 0")).weights


def test_mixing(spark, docs, nothing):
    body = [(i, ("the of " if i % 4 else "der und ") * (10 + i % 7), "en" if i % 4 else "de") for i in range(400)]
    df = spark.createDataFrame(body, "doc_id long, text string, domain string")
    labelled = df.where("doc_id % 2 = 0").select("doc_id", "domain")
    got = mixing.rates(df.drop("domain"), labelled, weights={"de": 0.5, "en": 0.5}, rounds=200).collect()
    want = {r["doc_id"]: r["domain"] for r in df.collect()}
    assert sum(r.domain == want[r.doc_id] for r in got) / len(got) > 0.95 and all(r.rate >= 0 for r in got)
    mass = defaultdict(float)
    for r in got:
        for k, p in r.posterior.items():
            mass[k] += r.rate * r.n_tokens * p
    assert mass["de"] == pytest.approx(mass["en"], rel=0.02) and sum(mass.values()) == pytest.approx(sum(r.n_tokens for r in got), rel=0.02)
    # The same fit by projected gradient descent over all documents at once.
    n, p = np.array([r.n_tokens for r in got], float), np.array([[r.posterior["de"], r.posterior["en"]] for r in got])
    target, rate = np.array([0.5, 0.5]) * n.sum(), np.ones(len(n))
    for _ in range(3000):
        rate = np.maximum(0, rate - p @ (p.T @ (rate * n) - target) / np.linalg.eigvalsh(p.T @ (p * n[:, None])).max())
    assert np.abs(rate - [r.rate for r in got]).max() < 0.05
    out = mixing.mix(df.drop("domain"), labelled, weights={"de": 0.5, "en": 0.5}, min_rate=1.0)
    assert out.columns == ["doc_id", "text"] and out.select("doc_id").distinct().count() == 400 and out.count() > 400
    assert mixing.rates(docs, labelled).count() == docs.count() and mixing.rates(nothing, labelled).count() == 0
    assert mixing.mix(docs, labelled.where("1 = 0"), min_rate=1.0).count() == docs.count()


def test_best_fill_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = rng.integers(1, 40, rng.integers(1, 9)).tolist()
        counts = {x: lengths.count(x) for x in lengths}
        picked = packing.best_fill(counts, 64)
        assert all(picked.count(x) <= counts[x] for x in picked) and max(lengths) in picked
        rest = list(lengths)
        rest.remove(max(lengths))
        sums = {max(lengths)}
        for x in rest:
            sums |= {s + x for s in sums if s + x <= 64}
        assert sum(picked) == max(sums)
        made = packing.plan(counts, 64)
        assert sorted(x for p, n in made for x in p * n) == sorted(lengths)


def test_packing(spark, docs, nothing):
    from tokenizers import Tokenizer

    raw = Tokenizer.from_file(f"{TOK}/byte_bpe_50k.json")
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(raw.encode(r.text or "", add_special_tokens=False).ids + [0])
    got = packing.pack_documents(docs, f"{TOK}/byte_bpe_50k.json", window=64).collect()
    places = defaultdict(list)
    for r in got:
        assert any(zlib.crc32(np.array(t[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and len(t) == r.doc_tokens for t in want[r.doc_id])
        places[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(t) for ts in want.values() for t in ts)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(places) <= total / 64 * 1.05 + 2
    assert packing.pack_documents(nothing, f"{TOK}/byte_bpe_50k.json").count() == 0
    assert [packing.padded_length(n) for n in (1, 3, 512, 1000, 1024)] == [1, 1024, 512, 1024, 1024]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    line = "A line that every single document repeats."
    rows = [(i, prose(i, 80) + "\n" + line + (" idiot moron scum" if i % 10 == 0 else ""), "en", f"src{i % 3}", 10) for i in range(60)]
    rows += [(100 + i, prose(1, 80) + "\n" + line, "en", "src0", 10) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    clean = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows if "idiot" not in r[1]} and clean.columns == columns
    less = corpus_pipeline.drop_lines(spark, clean, str(tmp_path))
    assert less.columns == columns and sum(line in r.text for r in less.collect()) == 1 and less.where("n_chars = length(text)").count() == less.count()
    one = corpus_pipeline.drop_near_copies(spark, less, str(tmp_path))
    left = {i for i in range(60) if i % 10} | {104}  # the copies' one long line repeats, so it stays in 104 alone
    assert {r.doc_id for r in one.collect()} == left and one.columns == columns
    mixed = corpus_pipeline.mix_domains(spark, one, str(tmp_path))
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} == {r.doc_id for r in one.collect()}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == left
    assert set(queries.SQL) < set(queries.QUERIES)


def test_pipeline_stages_on_odd_rows(spark, docs, nothing, tmp_path):
    """Nulls in any column, repeated rows, columns of any name, and no rows at all."""
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None), (1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for now in (docs, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, now, str(tmp_path))
            assert after.columns == docs.columns
            now = spark.createDataFrame(after.collect(), after.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
        assert sum(r.start == 0 for r in last) == now.count()
    assert not last


def test_lexicon_by_naive_search():
    """Aho-Corasick with exceptions against a search for every term at every place."""
    rng = np.random.default_rng(6)
    terms = {" idiot ": 3.0, " trash ": 2.0, " mor": 1.5, " moron ": 4.0, " clown ": 1.0, " so ": 0.5}
    lex = toxicity.Lexicon(terms)
    words = ["idiot", "trash", "can", "moron", "more", "clown", "fish", "so", "1d10t", "tr4sh", "the", "Trash!", "\u0456diot", "word"]
    for _ in range(300):
        text = " ".join(rng.choice(words, rng.integers(0, 25)))
        flat = toxicity.fold(text)
        at = lambda t: [i for i in range(len(flat)) if flat.startswith(t, i)]  # noqa: E731, B023
        free = [(i, i + len(p) + 1) for p in toxicity.EXCEPTIONS for i in at(f" {p} ")]
        best = {}
        for t, w in terms.items():
            for i in at(t):
                if not any(a <= i and i + len(t) - 1 <= b for a, b in free):
                    best[i] = max(best.get(i, 0), w)
        got = lex.features(text, lex.matcher())
        assert got == pytest.approx((np.log1p(sum(best.values())), 100 * sum(best.values()) / (flat.count(" ") or 1)))


def test_op7_blocks_of_long_texts(spark, monkeypatch):
    """Few long texts in more blocks than texts: some blocks are empty, and each link still counts once."""
    base = prose(7, 400).split()
    texts = [" ".join([*base[: 10 + 40 * i], f"other{i}", *base[11 + 40 * i :]]) for i in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(chosen_path, "BLOCK_SHINGLES", 150)
    got = {r.doc_id: (r.class_id, r.n_links, r.class_size) for r in chosen_path.near_classes(docs).collect()}
    assert got == {i: (0, 5, 6) for i in range(6)}


def test_mixing_meets_targets(spark):
    """Production defaults on eight overlapping domains: every total is at its target; targets out of reach are told, with the nearest totals."""
    rng = np.random.default_rng(5)
    score = rng.normal(0, 1.5, (600, 8)) + np.repeat([0, 2], [7, 1])
    p = np.exp(score) / np.exp(score).sum(1, keepdims=True)
    n = rng.integers(0, 400, 600)
    soft = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "__n long, __p array<double>").cache()
    blank = lambda k=8: mixing.Mixture([f"d{i}" for i in range(k)], [1 / k] * k, [], [])
    for how in ({}, {"min_rate": 0.2, "budget": float(n.sum())}):
        model = mixing.fit_rates(soft, blank(), **how)
        rate = np.array([r[0] for r in soft.select(model.rate(F.col("__p"))).collect()])
        assert model.met and (rate >= how.get("min_rate", 0)).all()
        np.testing.assert_allclose((rate * n) @ p, model.targets, rtol=1.01e-3)
    # Each document is half of either domain, so totals are equal whatever the rates; 3 to 1 leaves half of the budget at best.
    even = spark.createDataFrame([(10, [0.5, 0.5])] * 20, "__n long, __p array<double>")
    with pytest.warns(UserWarning, match="cannot be met"):
        model = mixing.fit_rates(even, blank(2), weights={"d0": 3.0, "d1": 1.0})
    assert not model.met and model.achieved == pytest.approx([100.0, 100.0])
    with pytest.raises(RuntimeError, match="did not settle"):
        mixing.fit_rates(soft, blank(), rounds=1)


def test_audio_finds_noisy_and_off_grid(spark):
    """Clips off the hop grid and bit noise up to the bound: what search finds is what align finds at any offset of any recording."""
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, rng.normal(0, 0.13, 64 + 6 * (i % 3)).tolist()) for i in range(10)], "id long, vector array<double>")
    stored = audio.fingerprints(audio.sonify(rows, 4096), 4096)
    prints = {r.id: np.frombuffer(r.print, "<u4") for r in stored.collect()}
    clips = {r.id: np.frombuffer(r.print, "<u4") for r in audio.fingerprints(audio.sonify(rows, 4096, clip=(0.53, 3.53)), 4096).collect()}
    for i in range(10):
        flips = (rng.random((38, 32)) < 0.15) @ (1 << np.arange(32))
        clips[100 + i] = prints[i][8:46] ^ flips.astype(np.uint32)
    asked = spark.createDataFrame([(i, bytearray(p.astype("<u4").tobytes())) for i, p in clips.items()], "id long, print binary")
    got = {r.query_id: r for r in audio.search(asked, stored).collect()}
    for i, q in clips.items():
        near = {}
        for j, p in prints.items():
            fits = []
            for o in range(-len(q), len(p)):
                a, b = max(0, -o), min(len(q), len(p) - o)
                e, turns = audio.align(q, p, o), [int((np.diff(x.astype(np.int64)) != 0).sum()) for x in (q[a:b], p[a + o : b + o])]
                if e <= audio.MAX_ERROR and min(turns) >= audio.MIN_TURNS and b - a >= min(audio.MIN_MEET, len(q), len(p)):
                    fits.append((-round((b - a) * 32 * (audio.MAX_ERROR - e), 6), abs(o), o, e))
            if fits:
                near[j] = min(fits)
        assert i % 100 in near
        e, j, o = min((e, j, o) for j, (_, _, o, e) in near.items())
        assert (got[i].match_id, got[i].offset, got[i].n_matches) == (j, o, len(near)) and got[i].bit_error == pytest.approx(e, abs=1e-6)


def test_audio_keeps_every_match(spark):
    """A print, its copy and two noisy versions: each is a row with its own offset and errors, and the copy is found by its class."""
    rng = np.random.default_rng(9)
    tune = rng.integers(0, 1 << 32, 60, dtype=np.uint32)
    noise = lambda share: ((rng.random((60, 32)) < share) @ (1 << np.arange(32))).astype(np.uint32)
    prints = {1: tune, 2: tune, 3: tune ^ noise(0.05), 4: np.r_[tune[:9], tune] ^ np.r_[np.zeros(9, np.uint32), noise(0.1)], 5: rng.integers(0, 1 << 32, 60, dtype=np.uint32)}
    frame = lambda d: spark.createDataFrame([(i, bytearray(p.astype("<u4").tobytes())) for i, p in d.items()], "id long, print binary")
    asked = {7: tune[10:40], 8: prints[5][:30], 9: np.zeros(30, np.uint32)}
    got = sorted(audio.matches(frame(asked), frame(prints)).collect(), key=lambda r: (r.query_id, r.match_id or 0))
    assert [(r.query_id, r.match_id, r.offset, r.n_copies) for r in got] == [(7, 1, 10, 2), (7, 3, 10, 1), (7, 4, 19, 1), (8, 5, 0, 1), (9, None, None, 0)]
    assert all(r.bit_error == pytest.approx(audio.align(asked[r.query_id], prints[r.match_id], r.offset), abs=1e-6) for r in got if r.match_id)
    assert {(r.id, r.class_id) for r in audio.members(frame(prints)).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)}
    best = {r.query_id: (r.match_id, r.n_matches) for r in audio.search(frame(asked), frame(prints)).collect()}
    assert best == {7: (1, 4), 8: (5, 1), 9: (None, 0)}
    found = {r.query_id: [(m.match_id, m.n_copies) for m in r.matches] for r in audio.search(frame(asked), frame(prints)).collect()}
    assert found == {7: [(1, 2), (3, 1), (4, 1)], 8: [(5, 1)], 9: []}
    # Null ids are left out, repeated ids and clashing columns stay, empty tables and prints give no match.
    odd = spark.createDataFrame([(None, bytearray(tune.astype("<u4").tobytes()), 1), (7, bytearray(tune[10:40].astype("<u4").tobytes()), 1), (7, bytearray(prints[5][:30].astype("<u4").tobytes()), 1), (6, None, 1)], "id long, print binary, q int")
    again = {r.query_id: sorted(m.match_id for m in r.matches) for r in audio.search(odd, frame(prints)).collect()}
    assert again == {7: [1, 3, 4, 5], 6: []}
    assert audio.search(odd.where("1 = 0"), frame(prints)).count() == 0 and audio.search(odd, odd.where("1 = 0")).where("n_matches = 0").count() == 2
    assert audio.fingerprints(spark.createDataFrame([(None, None), (1, bytearray(b"\0" * 9))], "id long, pcm binary"), 4096).where("octet_length(print) = 0").count() == 2
