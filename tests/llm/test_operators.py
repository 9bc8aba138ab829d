"""Each operator against a brute-force version, and on odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkscope.llm import bpe, chat, convnet, imatch, infill, license, mixing, neardup, negatives, pages, personal, queries, rules, runs, shards

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, "a b c d e f", "x", "s"), (1, "a b c d e f", "x", "s"), (2, None, None, None), (3, "", "y", "s"), (None, "a b c d e f", "x", "t"), (4, "  \n ", "x", "t"), (5, "ÄB <|endoftext|> \\### </turn>", "q", "t"), (6, "z " * 5000, "q", "t")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns that clash with the operators' own."""
    return spark.createDataFrame([(*r, 9, "v") for r in ODD], "doc_id long, text string, lang string, source string, n_words long, score string").cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def test_bpe_is_the_librarys(spark, odd, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in queries.op1_bpe(spark, SF).collect()}
    for d, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids
        assert got[d]["n_tokens"] == len(ids) and got[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    coded = bpe.bpe_decode(bpe.bpe_encode(odd)).collect()
    assert Counter((r["doc_id"], r["decoded"]) for r in coded) == Counter((r[0], r[1] or "") for r in ODD)
    assert bpe.bpe_encode(odd.limit(0)).count() == 0


def test_bpe_query_uses_the_operators(spark, monkeypatch):
    called = []
    for name in ("bpe_encode", "bpe_decode"):
        monkeypatch.setattr(bpe, name, lambda *a, f=getattr(bpe, name), n=name, **b: called.append(n) or f(*a, **b))
    queries.op1_bpe(spark, SF)
    assert called == ["bpe_encode", "bpe_decode"]


def shingle_tuples(text, w):
    words = lower(text or "").encode().split()
    return frozenset(zip(*(words[i:] for i in range(w)), strict=False)) if len(words) >= w else frozenset([tuple(words)] if words else [])


def components(sets, percent=80):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_near_duplicates_lose_no_link(spark, texts):
    want = components({d: shingle_tuples(t, 2) for d, t in texts.items()})
    got = {r["doc_id"]: r for r in queries.op2_near_duplicates(spark, SF).collect()}
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(r["kept"] == (d == want[d]) for d, r in got.items())


def test_near_duplicates_of_one_base(spark):
    """A group whose copies are linked with some of each other only."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in r.sample(range(60), r.randrange(0, 7)):
            w[j] = f"n{i}_{j}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(r.sample(base, 30))) for i in range(20)]
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == components({d: shingle_tuples(t, 2) for d, t in rows})


def test_near_duplicates_of_odd_rows(spark, odd):
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in neardup.near_duplicates(odd, 2).collect())
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True), (-1, None, True), (4, 4, True), (5, 5, True), (6, 6, True)], key=lambda x: (x[0],)) or Counter(got) == Counter([(1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True), (-1, None, True), (4, 4, True), (5, 5, True), (6, 6, True)])
    left = neardup.drop_near_duplicates(odd)
    assert left.columns == odd.columns and left.count() == 7
    assert neardup.near_duplicates(odd.limit(0), 2).count() == 0


def test_near_duplicates_of_one_id_with_two_texts(spark):
    """Texts that only share an id aren't linked, and none is lost, whatever the order."""
    rows = [(1, "alpha beta gamma delta", 1), (1, "one two three four", 2), (1, "one two three four", 3), (2, "one two three four", 4), (3, "alpha beta gamma delta", 5), (4, "", 6), (4, "", 7), (5, "x y", 8)]
    table = spark.createDataFrame(rows, "doc_id long, text string, extra long")
    got = neardup.near_duplicates(table, 2).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got) == Counter({(1, 1, True): 3, (2, 1, False): 1, (3, 1, False): 1, (4, 4, True): 2, (5, 5, True): 1})
    left = [Counter((r["doc_id"], r["text"]) for r in neardup.drop_near_duplicates(t, 2).collect()) for t in (table, table.orderBy(F.desc("extra")))]
    assert left[0] == left[1] == Counter({(1, "alpha beta gamma delta"): 1, (1, "one two three four"): 1, (4, ""): 2, (5, "x y"): 1})


def test_components_of_long_paths_and_stars(spark, monkeypatch):
    """A path of a thousand takes one round of ten steps, a large star one of a single step."""
    written = []
    real = neardup.cut
    monkeypatch.setattr(neardup, "cut", lambda df: written.append(1) or real(df))
    path = spark.range(999).selectExpr("id as a", "id + 1 as b")
    assert {r["component"] for r in neardup.components(path).collect()} == {0} and len(written) <= 16
    written.clear()
    star = spark.range(1, 50001).selectExpr("cast(0 as bigint) as a", "id as b")
    assert neardup.components(star).filter("component = 0").count() == 50001 and len(written) <= 7
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {r["id"]: r["component"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()} == {x: find(x) for e in edges for x in e}


def test_chances_of_losing_a_pair():
    """Exact: of bands, and of sketches, whose samples each flip two bits if they differ."""
    import numpy as np

    assert (1 - 0.8**neardup.ROWS) ** neardup.BANDS < 5e-8
    m, n, most = 64 * neardup.SKETCH_WORDS, neardup.SAMPLES, neardup.most_differing_bits()
    odd, refused = np.zeros(m + 1), 0.0
    odd[0] = 1
    k = np.arange(m + 1)
    from math import comb

    for differ in range(n + 1):
        refused += comb(n, differ) * 0.2**differ * 0.8 ** (n - differ) * odd[most + 1 :].sum()
        for _ in range(2):
            up = np.zeros(m + 1)
            up[1:] += odd[:-1] * (m - k[:-1]) / m
            up[:-1] += odd[1:] * k[1:] / m
            odd = up
    assert refused < 2.5e-8


def test_odd_sketches_estimate():
    import numpy as np

    r = np.random.default_rng(2)
    x = r.integers(0, 1 << 63, 1000).astype(np.uint64)
    for same in (0.9, 0.8, 0.5):
        n = int(1000 * 2 * same / (1 + same))
        y = np.concatenate([x[:n], r.integers(0, 1 << 63, 1000 - n).astype(np.uint64)])
        bits = int(np.bitwise_count((neardup.odd_sketch(neardup.min_hashes(x)) ^ neardup.odd_sketch(neardup.min_hashes(y))).view(np.uint64)).sum())
        m = 64 * neardup.SKETCH_WORDS
        assert abs(1 + m / (4 * neardup.SAMPLES) * np.log(1 - 2 * bits / m) - same) < 0.2


def test_chat_round_trip(spark):
    r = random.Random(1)
    pieces = ["#", "###", "\\", "</turn>", "<", "/turn>", "\n", ":\n", "### a:\n", "é"]
    for _ in range(2000):
        m = [("".join(r.choices(pieces, k=r.randrange(3))), "".join(r.choices(pieces, k=r.randrange(6)))) for _ in range(r.randrange(4))]
        assert chat.parse(chat.render(m)[0]) == m
    rows = [(1, 0, "start", None, "user", "he"), (1, 1, "delta", None, None, "llo"), (1, 2, "message", None, "assistant", "bad"), (1, 3, "message", None, "user", "again"), (1, 4, "regenerate", 1, None, None), (1, 5, "delta", 1, None, "good"), (1, 6, "edit", 0, None, "hi"), (2, 0, None, None, "assistant", None), (None, 0, "message", None, None, "x"), (3, 0, "message", None, "user", "gone"), (3, 1, "delete", 0, None, None), (3, 2, "delta", 7, None, "nothing")]
    log = spark.createDataFrame(rows, "conv_id long, seq int, kind string, ref long, role string, text string").withColumn("extra", F.lit(1))
    out = chat.format_conversations(log)
    got = {}
    for x in chat.parse_conversations(out).orderBy("conv_id", "turn").collect():
        got.setdefault(x["conv_id"], []).append((x["role"], x["text"]))
    assert got == {1: [("user", "hi"), ("assistant", "good")], 2: [("assistant", "")], None: [("", "x")]}
    assert out.count() == 4 and chat.format_conversations(log.limit(0)).count() == 0


def naive_fold(events):
    """Messages of one conversation's events, in sequence, by a list that is rewritten each time."""
    messages = []  # [number, role, text]
    opened = 0
    for kind, ref, role, text in events:
        text = text or ""
        if kind in (None, "message", "start"):
            messages.append([opened, role or "", text])
            opened += 1
            continue
        found = [m for m in messages if m[0] == ref] if ref is not None else messages[-1:]
        if not found:
            continue
        m = found[0]
        if kind == "delta":
            m[2] += text
        elif kind == "edit":
            m[2] = text
        elif kind == "delete":
            messages.remove(m)
        elif kind == "regenerate":
            m[2] = text
            messages = [x for x in messages if x[0] <= m[0]]
    return [(role, text) for _, role, text in messages]


def test_chat_of_random_logs(spark):
    """The fold against a naive one, and marks that stand exactly once a turn."""
    r = random.Random(4)
    said = ["###", "### assistant:\n", "</turn>\n", "x", "\\", "\\### A: </turn> ok", None, "####", "y " * 30000]
    rows, want = [], {}
    for c in range(120):
        log = [(r.choice(["message", "start", "delta", "delta", "edit", "delete", "regenerate", "other", None]), r.choice([None, None, 0, 1, 2, 9]), r.choice(["user", "assistant", "a:\n", None]), r.choice(said[:-1] if c else said)) for _ in range(r.randrange(1, 14))]
        rows += [(c, i, *e) for i, e in enumerate(log)]
        want[c] = naive_fold(log)
    r.shuffle(rows)
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, seq int, kind string, ref long, role string, text string"))
    got = {c: [] for c in want}
    for x in chat.parse_conversations(out).orderBy("conv_id", "turn").collect():
        got[x["conv_id"]].append((x["role"], x["text"]))
    assert got == want
    for x in out.collect():
        assert x["formatted"].count("###") == x["formatted"].count("</turn>") == len(want[x["conv_id"]])


def test_chat_query_folds_events(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    kinds = {r["kind"]: r["count"] for r in chat.as_events(rows).groupBy("kind").count().collect()}
    assert set(kinds) == {"start", "delta", "edit", "regenerate"}
    repeated = spark.createDataFrame([(1, 0, "user", "same text"), (1, 0, "user", "same text"), (1, 1, "assistant", None), (None, 0, "user", "z")], rows.schema)
    got = chat.parse_conversations(chat.format_conversations(chat.as_events(repeated))).orderBy("conv_id", "turn").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in got] == [(None, "user", "z"), (1, "user", "same text"), (1, "user", "same text"), (1, "assistant", "")]


def test_chat_digests(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    said = {}
    for r in rows:
        said.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    said[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    got = {r["conv_id"]: r for r in queries.op3_chat_format(spark, SF).collect()}
    assert set(got) == set(said)
    for c, turns in said.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (got[c]["n_turns"], got[c]["loss_chars"]) == (len(turns), len(loss))
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()


def test_shards(spark, odd, docs, texts):
    rows = queries.op4_histogram_shards(spark, SF).collect()
    size, slots = Counter(), {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "bytes")
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # brute force: rows in key order, each splitter where the bytes below come nearest to its target
    out = shards.histogram_shards(docs)
    assert out.columns == [*docs.columns, "shard", "slot"]
    at = {r["doc_id"]: r["at"] for r in docs.select("doc_id", shards.sort_key(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("at")).collect()}
    order = sorted(texts, key=lambda d: (at[d], d))
    total, below, upto = sum(size.values()), 0, [0]
    for d in order:
        below += len(texts[d].encode()) + 1
        upto.append(below)
    where = {r["doc_id"]: (r["shard"], r["slot"]) for r in out.collect()}
    assert [where[d] for d in order] == sorted(where.values())
    end = 0
    for s in range(7):
        end += sum(w[0] == s for w in where.values())
        target = total * (s + 1) / 8
        nearest = min(abs(u - target) for u in upto)
        assert abs(upto[end] - target) <= nearest + shards.TOLERANCE * total / 8
    hot = spark.range(40000).selectExpr("id as doc_id", "if(id % 2 = 0, 'copy', concat('text ', id)) as text", "7 as shard")
    got = shards.histogram_shards(hot)
    assert got.columns == ["doc_id", "text", "shard", "slot"] and got.count() == 40000
    held = [r["b"] for r in got.groupBy("shard").agg(F.sum(shards.text_bytes(F.col("text"))).alias("b")).collect()]
    assert len(held) == 8 and max(held) < 1.01 * min(held)
    sized = hot.select(shards.sort_key(F.col("text"), F.col("doc_id")).alias("hi"), F.lit(0).cast("long").alias("lo"), F.lit(1).cast("long").alias("weight"))
    edges = runs.run_edges(sized, 4000)
    assert max(r["count"] for r in sized.groupBy(runs.run_of(edges, F.col("hi"), F.col("lo"))).count().collect()) <= 4000
    same = spark.range(800).selectExpr("id as doc_id", "'copy' as text")
    assert set(Counter(r["shard"] for r in shards.histogram_shards(same).collect()).values()) == {100}
    assert shards.histogram_shards(odd).count() == len(ODD) and shards.histogram_shards(odd.limit(0)).count() == 0


def test_imatch(spark, odd, texts):
    got = {r["doc_id"]: r for r in queries.op5_imatch(spark, SF).collect()}
    ids = sorted(texts)
    prints = {}
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        t, n = texts[a], len(texts[a])
        edited = t[: n - n // 2] + texts[b][: n // 2]
        assert got[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[a]["n_chars"] == n
        assert prints.setdefault(t, got[a]["fingerprint"]) == got[a]["fingerprint"]
    mean = lambda c: sum(r[c] for r in got.values()) / len(got)
    assert mean("near_edited") > 0.1 > mean("near_next")
    out = imatch.imatch(odd).collect()
    assert len(out) == len(ODD) and len({r["fingerprint"] for r in out if r["n_chars"] == 11}) == 1
    assert imatch.imatch(odd.limit(0)).count() == 0 and imatch.imatch(odd.limit(1)).count() == 1


def test_imatch_by_brute_force(spark):
    """Fingerprints and likeness from sets of terms: equal subsets have equal hashes."""
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choices(vocabulary, k=r.randrange(0, 90))) for _ in range(60)]
    texts += [texts[0], "", "Only ÄB words"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in imatch.imatch(table).collect()}
    lex = {x["term"] for x in imatch.lexicon(table.withColumn("tie", F.xxhash64("text"))).collect()}
    words = sorted({lower(w) for t in texts for w in WORD.findall(t)})
    code = {x["w"]: (x["h"], *[x[f"b{b}"] for b, _ in imatch.SCALES]) for x in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h"), *[F.xxhash64(F.xxhash64("w"), F.lit(b)).bitwiseAND((1 << b) - 1).alias(f"b{b}") for b, _ in imatch.SCALES]).collect()}
    # the band: one of a group of copies counts
    df = Counter(w for t in set(texts) for w in {lower(x) for x in WORD.findall(t)})
    n = len(set(texts))
    for w, (h, *_) in code.items():
        assert (h in lex) == (max(2, imatch.MIN_SHARE * n) - 0.01 <= df[w] <= max(2, imatch.MAX_SHARE * n))

    def subsets(t):
        mine = {code[lower(w)] for w in WORD.findall(t)}
        return [frozenset(h for h, *at in mine if h in lex and at[s] == i) for s, (_, m) in enumerate(imatch.SCALES) for i in range(m)]

    def alike(a, b):
        if a == b:
            return 1.0
        x, y = subsets(a), subsets(b)
        some = sum(bool(p or q) for p, q in zip(x, y, strict=True))
        return sum(bool(p) and p == q for p, q in zip(x, y, strict=True)) / some if some else 0.0

    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        if any(lower(w) not in code for w in WORD.findall(edited)):
            continue  # a word cut in two that no text has
        assert got[i]["near_next"] == pytest.approx(alike(t, following)) and got[i]["near_edited"] == pytest.approx(alike(t, edited))
        for j in range(i):
            assert (got[i]["fingerprint"] == got[j]["fingerprint"]) == ((subsets(t) == subsets(texts[j]) and any(subsets(t))) or t == texts[j])


def test_imatch_with_a_third_of_copies(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(1500)]
    first = r.choices(vocabulary, k=120)
    rows = [(i, " ".join(r.choices(vocabulary, k=120))) for i in range(400)]
    for i in range(400, 600):  # near copies with two other words, and a few exact ones
        w = list(first)
        if i % 10:
            w[r.randrange(120)], w[r.randrange(120)] = r.choices(vocabulary, k=2)
        rows.append((i, " ".join(w)))
    r.shuffle(rows)
    table = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    copies = {i for i, (d, _) in enumerate(rows) if d >= 400}
    out = imatch.imatch(table).collect()
    assert len(out) == 600 and sum(x["fingerprint"].startswith("text:") for x in out) == 0
    likeness = [x["near_edited"] for x in out if x["doc_id"] in copies]
    assert sum(x > 0 for x in likeness) > 0.95 * len(copies)
    weighed = imatch.weighed_docs(table.withColumn("tie", F.xxhash64("text")))
    assert 400.9 <= weighed.agg(F.sum("weight")).first()[0] <= 410


def test_runs_split_hot_keys(spark):
    """Runs hold what they may, keep the order, and cut inside one key."""
    r = random.Random(8)
    rows = [(-1 if i % 7 == 0 else 5 if i % 3 == 0 else r.randrange(1 << 62), r.randrange(1 << 62), r.randrange(1, 50)) for i in range(6000)]
    table = spark.createDataFrame(rows, "hi long, lo long, weight long")
    edges = runs.run_edges(table, 2000)
    assert edges == sorted(edges)
    got = table.withColumn("run", runs.run_of(edges, F.col("hi"), F.col("lo"))).collect()
    for x in got:
        assert x["run"] == sum(e <= (x["hi"], x["lo"]) for e in edges)
    weight = Counter()
    for x in got:
        weight[x["run"]] += x["weight"]
    nulls = sum(w for h, _, w in rows if h < 0)
    assert max(weight.values()) <= 2000 and nulls > 4000


def test_main_text(spark):
    got = {r["page_id"]: r for r in queries.op6_main_text(spark, SF).collect()}
    import html

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", body)]
        assert got[r["page_id"]]["text"] == "\n\n".join(p for p in parts if p)
    shell = "<html><body><div id='head'>Site</div><div class='main'><p>{}<p>{}</div><div class=comments><p>first!</div><script>x('<p>')</script><p>Contact us</body></html>"
    rows = [(i, "http://h.example/x", shell.format(f"Text &amp; {i}.", f"More\n  {i * i}.")) for i in range(6)] + [(7, None, None), (8, "", ""), (9, "http://o.example", "<p>only <b>this</b>&nbsp;one")]
    out = {r["page_id"]: r["text"] for r in pages.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert out[3] == "Text & 3.\n\nMore 9." and out[7] == out[8] == "" and out[9] == "only this one"
    assert pages.parse_html("<div>" * 5000 + "deep") and pages.blocks(pages.parse_html("<p>a<table><tr><td>b<td>c</table>d")) == ["a", "b", "c", "d"]


def test_main_text_without_names(spark):
    """Elements and classes disguised, or the article's own element gone: the same text."""
    r = random.Random(6)
    rows = [(x["page_id"], x["url"], x["html"]) for x in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    hosts = Counter(re.sub(r"^\w+://([^/?#]*).*", r"\1", u) for _, u, _ in rows)
    rows = [x for x in rows if hosts[re.sub(r"^\w+://([^/?#]*).*", r"\1", x[1])] > 1]

    def disguised(html, article):
        html = html.replace("<article>", article).replace("</article>", "</div>" if article else "")
        for tag in ("nav", "footer"):
            html = html.replace(f"<{tag}>", f"<div class=x{r.randrange(10**6)}>").replace(f"</{tag}>", "</div>")
        return html.replace('class="ad"', f'class="c{r.randrange(10**6)}"')

    kind = "page_id long, url string, html string"
    texts = lambda x: {p["page_id"]: p["text"] for p in pages.extract_main_text(spark.createDataFrame(x, kind)).collect()}
    plain = texts(rows)
    for article in ("<div>", ""):
        assert texts([(i, u, disguised(h, article)) for i, u, h in rows]) == plain


def test_imatch_weighs_a_group_of_any_size_as_one(spark):
    """1,200,000 equal texts beside 3,000 others: their terms stay in the band of the others."""
    own = spark.range(3000).selectExpr("id as doc_id", "concat('term', id % 300, ' word', id % 7, ' own', id) as text")
    same = spark.range(3000, 1_203_000).selectExpr("id as doc_id", "'term5 term6 copied' as text")
    table = own.unionByName(same)
    lex = {x["term"] for x in imatch.lexicon(table.withColumn("tie", F.xxhash64("text"))).collect()}
    want = {x["c"] for x in spark.range(300).select(F.xxhash64(F.concat(F.lit("term"), "id")).alias("c")).collect()} | {x["c"] for x in spark.range(7).select(F.xxhash64(F.concat(F.lit("word"), "id")).alias("c")).collect()}
    assert lex == want


def test_main_text_keeps_leads_closings_and_repeated_headings(spark):
    body = "<div><p>Lead {0} of the matter, told in short {1}.</p></div><h1>Title {0}</h1><p>Body {0} goes on {1} and on for a while, {1}.</p><h2>Summary</h2><p>In short {0} it was {1}.</p><section><h3>At the end</h3><p>Ending {0} of it all {1}.</p></section>"
    shell = "<html><body><div><a href=/a>Home</a><a href=/b>News</a></div><{2}>" + body + "</{2}><div>Some bare notice {1}</div><div>All rights kept.</div></body></html>"
    rows = [(10 * k + i, f"http://h{k}.example/{i}", shell.format(i, " ".join(f"w{i}x{j}" for j in range(9)), tag)) for k, tag in enumerate(("article", "div")) for i in range(6)]
    got = {x["page_id"]: x["text"].split("\n\n") for x in pages.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(2):
        for i in range(6):
            blocks = got[10 * k + i]
            assert [b.split()[0] for b in blocks] == ["Lead", "Title", "Body", "Summary", "In", "At", "Ending"], (k, blocks)


def test_main_text_drops_what_is_constant(spark):
    """Inside an article too; a page's own text on such a place stays; copies tell nothing."""
    shell = "<html><body><article><h1>On {0}</h1><p>Read our terms of use.</p><p>Story {0} begins.</p><p>It ends {0} times.</p></article></body></html>"
    rows = [(i, "http://h.example/x", shell.format(i)) for i in range(8)] + [(8, "http://h.example/y", shell.format(8).replace("Read our terms of use.", "An own paragraph."))]
    rows += [(20 + i, "http://copies.example/x", shell.format("all")) for i in range(5)]
    rows += [(30, "http://h.example/long", shell.format(30).replace("begins", "begins " * 20_000)), (31, None, None), (31, None, None)]
    got = [(x["page_id"], x["text"]) for x in pages.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    text = dict(got)
    assert len(got) == len(rows) and text[3] == "On 3\n\nStory 3 begins.\n\nIt ends 3 times." and text[31] == ""
    assert text[8] == "On 8\n\nAn own paragraph.\n\nStory 8 begins.\n\nIt ends 8 times."
    assert text[22] == "On all\n\nRead our terms of use.\n\nStory all begins.\n\nIt ends all times." and len(text[30]) > 120_000
    assert pages.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_network_by_loops():
    """Scores by plain loops over bytes, and the training step's gradient by differences."""
    import numpy as np

    r = np.random.default_rng(3)
    net = convnet.ByteNet.start(5)
    net.bias = r.normal(0, 0.3, convnet.FILTERS).astype(np.float32)
    texts = [b"", b"abc", bytes(r.integers(1, 256, 700, dtype=np.uint8)), "Zürich ".encode() * 9]

    def slow(raw):
        stride, responses = convnet.CHUNK - convnet.OVERLAP, []
        at = 0
        while True:
            chunk = raw[at : at + convnet.CHUNK].ljust(convnet.CHUNK, b"\0")
            best = []
            for f in range(convnet.FILTERS):
                top = -1e9
                for p in range(0, convnet.CHUNK - convnet.WIDTH + 1, convnet.STEP):
                    s = sum(float(net.embed[chunk[p + i], d]) * float(net.filters[i * convnet.SIZE + d, f]) for i in range(convnet.WIDTH) for d in range(convnet.SIZE))
                    top = max(top, s)
                best.append(max(0.0, top + float(net.bias[f])))
            responses.append(best)
            at += stride
            if at + convnet.OVERLAP >= len(raw):
                break
        x = np.array(responses)
        z = float(np.concatenate([x.mean(0), x.max(0)]) @ net.weights) + net.offset
        return 1 / (1 + np.exp(-z))

    assert net.scores(texts) == pytest.approx([slow(t) for t in texts], abs=1e-4)
    long = [b"word " * 40_000, b"x"]
    assert net.scores(long)[0] == pytest.approx(net.scores(long[:1])[0])
    good, bad = [b"fine prose here. " * 20] * 20, [b"$$$ buy now!!! " * 20] * 20
    learned = convnet.train(good + bad, np.array([1.0] * 20 + [0.0] * 20), 0.5, epochs=30)
    assert learned.scores(good[:1])[0] > 0.9 > 0.1 > learned.scores(bad[:1])[0]


def test_classifier_of_no_documents(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert convnet.quality_scores(odd.limit(0), labels).count() == 0 and convnet.quality_scores(odd, labels).count() == len(ODD)


def test_classifier(spark, odd):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = queries.op7_quality_cnn(spark, "/root/testdata/sf0.01").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in held) / len(held) > 0.9
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["predicted"] for r in convnet.quality_scores(odd, none).collect()} == {1}
    assert convnet.quality_keep(odd, none).columns == odd.columns


def sainte_lague(targets, house):
    seats = Counter()
    heap = [(-t, s) for s, t in targets.items() if t > 0]
    heapq.heapify(heap)
    for _ in range(house):
        _, s = heapq.heappop(heap)
        seats[s] += 1
        heapq.heappush(heap, (-targets[s] / (2 * seats[s] + 1), s))
    return seats


def test_mixing(spark, odd, docs, texts):
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    size = Counter()
    for d, t in texts.items():
        size[source[d]] += len(WORD.findall(t))
    names = sorted(size)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, free, wanted = {}, set(names), 1.5 * sum(size.values())
    while free:
        level = (wanted - sum(2 * size[s] for s in names if s not in free)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            break
        free -= over
    target = {s: level * weight[s] if s in free else 2.0 * size[s] for s in names}
    rows = mixing.mix(docs).collect()
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]])) and 0 <= r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(target[r["source"]])
    quota = {r["source"]: r["quota"] for r in rows}
    for shard in range(1, mixing.SHARDS + 1):
        house = round(sum(target.values()) / mixing.BLOCK * shard / mixing.SHARDS)
        seats = sainte_lague(target, house)
        assert {s: sum(quota[s][:shard]) for s in names} == {s: seats[s] for s in names}
    assert all(taken[s] == min(mixing.BLOCK * sum(quota[s]), 2 * size[s]) for s in names)
    again = mixing.mix(docs.orderBy(F.rand(3))).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in again) == Counter((r["doc_id"], r["taken"]) for r in rows)
    # each shard takes its quota of blocks, and the words of a document add up
    shares = {s: [sum(r["shard_words"][j] for r in rows if r["source"] == s) for j in range(mixing.SHARDS)] for s in names}
    for s in names:
        ends = [min(mixing.BLOCK * sum(quota[s][: j + 1]), 2 * size[s]) for j in range(mixing.SHARDS)]
        assert shares[s] == [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert all(sum(r["shard_words"]) == r["taken"] and min(r["shard_words"]) >= 0 for r in rows)
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(odd.limit(0)).count() == 0
    dealt = Counter()
    for r in mixing.mix_rows(docs, shard="shard").collect():
        dealt[r["source"], r["shard"]] += len(WORD.findall(r["text"]))
    assert dealt == Counter({(s, j): n for s in names for j, n in enumerate(shares[s]) if n})
    out = mixing.mix_rows(docs)
    assert out.columns == docs.columns
    assert sum(len(WORD.findall(r["text"])) for r in out.collect()) == sum(taken.values())


def windows(words):
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)})


def test_rules(spark, odd, texts):
    for r in queries.op9_quality_rules(spark, SF).collect():
        t = texts[r["doc_id"]]
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), windows(w))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * want[4] > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    # the posterior from the counts, by loops over the rules
    counted = rules.cut(rules.add_counts(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), keep_text=False))
    model = rules.fit_votes(counted)
    votes = {x["doc_id"]: [x[k] for k in rules.rules()] for x in counted.select("doc_id", *[v.alias(k) for k, v in rules.rules().items()]).collect()}
    for r in queries.op9_quality_rules(spark, SF).collect():
        good, bad = model.prior, 1 - model.prior
        for i, v in enumerate(votes[r["doc_id"]]):
            if v != rules.ABSTAIN:
                good *= model.right_on_good[i] if v == rules.GOOD else 1 - model.right_on_good[i]
                bad *= model.right_on_bad[i] if v == rules.BAD else 1 - model.right_on_bad[i]
        assert r["p_good"] == pytest.approx(good / (good + bad), abs=1e-9) and r["kept"] == (not r["base_failed"] and r["p_good"] >= 0.5)
    got = rules.quality_verdicts(odd)
    assert got.count() == len(ODD) and got.filter("kept").count() == 0
    assert rules.quality_filter(odd).columns == odd.columns and rules.quality_verdicts(odd.limit(0)).count() == 0


def test_em_finds_the_accuracies():
    import numpy as np

    r = np.random.default_rng(1)
    good = r.random(20000) < 0.8
    right = np.array([0.95, 0.9, 0.97, 0.8])
    votes = np.where(r.random((20000, 4)) < 0.1, rules.ABSTAIN, np.where((r.random((20000, 4)) < right) == good[:, None], rules.GOOD, rules.BAD))
    m = rules.fit(votes, np.ones(20000))
    assert abs(m.prior - 0.8) < 0.08 and ((m.posterior(votes) >= 0.5) == good).mean() > 0.97


def test_license(spark, odd, texts):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in queries.op10_license_scan(spark, SF).collect():
        w = cut.findall(lower(texts[r["doc_id"]]))
        at = [(i, label) for p, label in license.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    rows = [(1, "Redistribution and use in source and (really) binary forms, with or without modification, are permitted"), (2, "cc by cc by"), (3, None), (4, "of the license and use in")]
    got = {r["doc_id"]: r for r in license.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "bsd" and got[2]["n_base"] == 2 and got[2]["last_word"] == 2 and got[4]["labels"] == "" and got[3]["n_words"] == 0
    assert license.license_scan(odd).count() == len(ODD) and license.license_scan(odd.limit(0)).count() == 0


def test_license_counts_its_own_words(spark):
    rows = [(1, "cc by a\0b"), (2, "\0"), (3, "a-b C+d")]
    got = {r["doc_id"]: (r["n_words"], r["n_base"]) for r in license.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (4, 1), 2: (0, 0), 3: (4, 0)}


def test_license_words_left_out(spark):
    bsd = "redistribution and use in source and binary forms with or without modification are permitted"
    one, two = bsd.replace(" or", ""), bsd.replace(" or without", "")
    rows = [
        (1, f"x {one} y"),
        (2, two),
        (3, bsd.replace(" use", "").replace(" or", "")),
        (4, f"{one} {'z ' * 40}{two}"),  # two places in one text
        (5, bsd.replace(" use", "").replace("with", "really with")),  # less, then more
        (6, bsd.replace(" forms", "").replace("permitted", "also permitted").replace(" or ", " or use in ")),
        (7, "modification are permitted forms with or without redistribution and use in source and binary"),  # out of order
    ]
    got = {r["doc_id"]: r for r in license.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in range(1, 8)] == ["bsd"] * 6 + [""]
    assert [got[i]["score"] for i in (1, 2, 3, 4, 5)] == pytest.approx([13 / 14, 12 / 14, 12 / 14, 13 / 14, 13 / 14])
    assert [(s["start"], s["stop"]) for s in got[1]["spans"]] == [(1, 14)]
    assert [(s["start"], s["stop"]) for s in got[4]["spans"]] == [(0, 13), (53, 65)]


def test_pipeline_of_odd_rows(spark, odd, tmp_path):
    """Odd rows, further columns and empty tables run through all stages."""
    import corpus_pipeline

    good = "The river runs past the old mill and the people of the town walk along it every evening, talking about the day. "
    more = spark.createDataFrame([(10 + i, good * (i + 1) + f"Number {i} of these texts.", "en", "s" if i % 2 else None, 9, "v") for i in range(8)], odd.schema)
    labels = spark.createDataFrame([(10, 1), (3, 0)], "doc_id long, quality int")
    for name, docs in (("odd", odd.union(more)), ("none", odd.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        at = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, str(tmp_path / name)).cache()
            assert sorted(at.columns) == sorted(odd.columns)
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() == at.count()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert sorted(after.columns) == sorted(docs.columns)
        docs = after.cache()
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == docs.count() > 0 and out.filter("n_tokens = 0").count() == 0


def infill_plain(doc_id, text, rate=100):
    """The output by slices of a str."""
    text = text or ""
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_infill_equals_slices_and_comes_back(spark, odd, texts):
    r = random.Random(3)
    made = ["".join(r.choice(["a", "ß", "\n", "\n\n", "😀", "<", "P>", " <M", ">"]) for _ in range(r.randrange(40))) for _ in range(400)]
    made += ["\n", "\n\n\n", "x", "x\n", "\ny", "<P>", "a\n<S>\nb", "<M", "l\n" * 200_000, "w" * 3_000_000, "<P", "S>\n<", "\u0000\n\u0000"]
    rows = [(i, t) for i, t in enumerate(made)] + list(texts.items())
    got = infill.restore_middle(infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(got) == len(rows)
    want = Counter((i, *infill_plain(i, t), t) for i, t in rows)
    assert Counter((x["doc_id"], x["n"], x["form"], x["prefix_chars"], x["middle_chars"], x["infill"], x["restored"]) for x in got) == want
    assert {x["form"] for x in got} == {"plain", "psm", "spm"}
    some = infill.fill_in_middle(odd, rate=30).collect()
    assert Counter((x["doc_id"], x["form"], x["infill"]) for x in some) == Counter((x[0], *infill_plain(x[0], x[1], 30)[1::3]) for x in ODD)
    clash = infill.restore_middle(infill.fill_in_middle(odd.withColumn("form", F.lit(3)).withColumn("n", F.lit("x")).withColumn("restored", F.lit(1))))
    assert Counter(x["restored"] for x in clash.collect()) == Counter(x[1] or "" for x in ODD)
    assert infill.restore_middle(infill.fill_in_middle(odd.limit(0))).count() == 0


def test_rotation():
    for n in range(7):
        for start in range(n + 1):
            for end in range(start, n + 1):
                for cut in range(start, end + 1):
                    b = bytearray(range(n))
                    infill.rotate(b, start, cut, end)
                    x = list(range(n))
                    assert list(b) == x[:start] + x[cut:end] + x[start:cut] + x[end:]


PERSONAL = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def personal_plain(text):
    """Base spans by the patterns as they are written."""
    out = []
    for kind, pattern in PERSONAL.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            twice = [int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))]
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 13 <= len(digits) <= 19 and sum(twice) % 10 == 0) or (kind == "phone" and 9 <= len(digits) <= 15):
                out.append((kind, *m.span()))
    return out


def viterbi_plain(field, text):
    """States of all tokens, line by line, in plain loops over all paths' best."""
    out, line = [], []
    shapes = personal.tokens(text)[2].tolist()
    for c in [*shapes, 0]:
        if c:
            line.append(c)
            continue
        row = [0, 0, *line, 0, 0]
        own = [[sum(float(field.emit[d][row[t + d]][s]) for d in range(5)) for s in range(personal.STATES)] for t in range(len(line))]
        paths = {s: (own[0][s] + float(field.move[0][s]), [s]) for s in range(personal.STATES)} if line else {0: (0, [])}
        for t in range(1, len(line)):
            paths = {s: max(((v + float(field.move[p][s]) + own[t][s], [*w, s]) for p, (v, w) in paths.items()), key=lambda x: x[0]) for s in range(personal.STATES)}
        out += max(paths.values(), key=lambda x: x[0])[1] + [0]
        line = []
    return out[:-1]


@pytest.fixture(scope="module")
def field():
    return personal.trained()


def test_personal_field_decodes_as_plain_viterbi(field, texts):
    """Leaving out what is proven to be outside changes nothing."""
    assert field.reach is not None
    r = random.Random(7)
    parts = ["word", "the", " ", " ", ".", ",", "\n", "(", ")", "555", "-", "0142", "+1", "key", "=", '"', "a1b2c3d4e5f6a7b8c9d0", "at", "dot", "@", "com", "ß", "1234567890123456", "v2", "/", "_"]
    made = ["".join(r.choice(parts) for _ in range(r.randrange(120))) for _ in range(150)]
    made += ["", "\n", " ", "(", "x" * 50, "word " * 300 + "(555) 201-3344 " + "word " * 300, *[t for t in list(texts.values())[:40] if len(t) < 4000]]
    made += [text for text, _ in personal.labelled_lines(personal.LINES)]
    for text in made:
        shapes = personal.tokens(text)[2]
        assert personal.viterbi(field, shapes).tolist() == viterbi_plain(field, text), text
    whole = personal.Field(field.emit, field.move)
    text = "\n".join(made)
    assert personal.field_spans(field, text) == personal.field_spans(whole, text)
    assert personal.field_spans(field, text) == [(k, a + o, b + o) for t, o in zip(made, [sum(len(x) + 1 for x in made[:i]) for i in range(len(made))], strict=True) for k, a, b in personal.field_spans(field, t)]


def test_personal_field_learns_its_table_and_holds_out(field):
    """All lines of the table are fitted; trained on four fifths, most others come right."""
    rows = personal.labelled_lines(personal.LINES)
    named = lambda f, t: [(personal.KINDS[k], a, b) for k, a, b, base in personal.spans(f, [t])[0] if not base]
    assert all(sorted(named(field, t)) == sorted(s) for t, s in rows)
    right = 0
    for fold in (0, 2):
        f = personal.train([x for i, x in enumerate(personal.LINES) if i % 5 != fold], rounds=120)
        right += sum(sorted(named(f, t)) == sorted(s) for i, (t, s) in enumerate(rows) if i % 5 == fold)
    n = sum(i % 5 in (0, 2) for i in range(len(rows)))
    assert right >= 0.8 * n, (right, n)


def test_personal_base_spans(spark, texts):
    r = random.Random(11)
    bits = ["a", "b.c", "@", "@x.y", ".", "-", " ", "+", "1", "23", "255", "256", "4111 1111 1111 1111", "4111-1111 1111 1111", "+1 (555) 201-3344", "(", ")", "10.0.0.1", "1.2.3", "é", "\n", "%", "_"]
    made = ["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(3000)]
    made += ["a@b.c@d.e", "a@b@c.d", "1.2.3.4.5.6.7.8", "1.2.3.4.5", "0001.2.3.4", "+1234567890123456", "1" * 200_000, "a" * 200_000 + "@", "@" * 1000, "1.1." * 5000, "9 " * 9 + "-" * 9]
    for t in [*made, *texts.values()]:
        assert [(personal.KINDS[k], a, b) for k, a, b in personal.base_spans(t)] == personal_plain(t) if len(t) < 100_000 else personal.base_spans(t) == []


def test_personal_spans_and_mask(spark, odd, field):
    said = "tel (555) 201-3344, mail a@b.org or jo (at) example (dot) org\ntoken = \"9f8b2c4d6e1a7c3b5d9e8f7a6b5c4d3e\" é 10.0.0.1"
    rows = [(1, said), (2, None), (3, ""), (4, "clean words only, 12 of them."), (1, said), (5, "😀 " + said), (6, ("plain words of no interest, " * 40 + "\n") * 400 + said)]
    got = {r["doc_id"]: r for r in personal.mask_personal_data(personal.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    masked = 'tel <phone>, mail <email> or <email>\ntoken = "<secret>" é <ip>'
    assert got[1]["masked"] == masked and got[5]["masked"] == "😀 " + masked and got[2]["masked"] == got[3]["masked"] == "" and got[4]["masked"] == rows[3][1]
    assert got[6]["masked"].endswith(masked) and len(got[6]["spans"]) == 5
    assert [(s["kind"], said[s["start"] : s["end"]], s["base"]) for s in got[1]["spans"]] == [("email", "a@b.org", True), ("email", "jo (at) example (dot) org", False), ("ip", "10.0.0.1", True), ("phone", "(555) 201-3344", False), ("secret", "9f8b2c4d6e1a7c3b5d9e8f7a6b5c4d3e", False)]
    clash = personal.find_personal_data(odd.withColumn("spans", F.lit(1)).withColumn("masked", F.lit(1)))
    assert Counter(len(r["spans"]) for r in clash.collect()) == {0: len(ODD)} and personal.mask_personal_data(clash).count() == len(ODD)
    assert personal.find_personal_data(odd.limit(0)).count() == 0


def test_strassen_is_the_product():
    r = np.random.default_rng(1)
    for m, k, n in [(1, 1, 1), (17, 33, 40), (64, 64, 64), (50, 100, 75), (5, 200, 300), (33, 35, 129)]:
        a, b = r.integers(-(2**24), 2**24, (m, k)), r.integers(-(2**24), 2**24, (n, k))
        assert (negatives.product(a, b).astype(object) == a.astype(object) @ b.T.astype(object)).all()
    with pytest.raises(OverflowError):
        negatives.inner_products(np.full((20, 20), 2**30), np.full((20, 20), 2**30))


def negatives_plain(rows, k=5, m=3):
    """All pairs, in plain integers."""
    import math

    got = {}
    for d, lab, v in rows:
        if d is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            got[d] = ((lab + 1) % 10 if d % 7 == 0 else lab, [math.floor(256 * x) for x in v])
    out = []
    for a, (la, va) in got.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=False)), d, lab == la) for d, (lab, v) in got.items() if d != a)
        for ps, p, _ in [x for x in scored if x[2]][:k]:
            inside = [x for x in scored if not x[2] and 50 * -ps <= 100 * -x[0] <= 95 * -ps][:m]
            out += [(a, p, i + 1, d, -ps, -ns) for i, (ns, d, _) in enumerate(inside)]
    return out


def test_hard_negatives_equal_all_pairs(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i, r.choice([0, 0, 0, 0, 1, 2, 3]), [r.choice([-0.5, 0.25, 0.5, 0.7]) + r.random() * r.choice([0, 1]) for _ in range(5)]) for i in range(700)]
    rows += [(1000 + i, 0, [0.5, 0.5, 0.5, 0.5, 0.5]) for i in range(300)]  # a third alike
    rows += [(2000, None, [1.0] * 5), (2050, 1, None), (2100, 1, [1.0, None]), (2150, 1, [float("nan")] * 5), (2151, 2, [float("inf")] * 5), (None, 1, [1.0] * 5), (2200, 1, []), (2250, 5, [9.0, 9.0, 1.0]), (2201, 6, [1.0] * 70)]
    table = spark.createDataFrame([(*x, "x", 3) for x in rows], "vec_id long, label int, embedding array<double>, row string, v int")

    def mined(t):
        lab = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
        return negatives.hard_negatives(negatives.vectors_as_integers(t.withColumn("label", lab)), F.col("id") % 50 == 0)

    want = Counter(negatives_plain(rows))
    assert Counter(map(tuple, mined(table.unionByName(table.limit(20))).collect())) == want and len(want) > 100
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    monkeypatch.setattr(negatives, "CANDIDATES", 64)
    assert Counter(map(tuple, mined(table).collect())) == want
    assert mined(table.limit(0)).count() == 0
    assert mined(table.filter("vec_id % 50 <> 0")).count() == 0
