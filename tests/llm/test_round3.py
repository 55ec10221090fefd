"""Alignment, periodic runs and exact dedup against plain second implementations, on odd rows, hot groups and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from vecloom.llm import alignment, exact, pages, queries, runs

D = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, id long, row long, digest string, h long, `a.b` string, chunk long, stripe int, runs int, n string, maybe boolean, _id int"


def table(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, 7, 1, "x", 5, "dot", 3, 2, 4, "n", True, 9) for i, t in zip(ids, texts)], CLASH)


ODD = [None, "", " \n\t ", "one", "one", "o n\te", "A b C", "é ü ß 漢字かな <|endoftext|> </s> don't it's. x\r\n y\r z ", "\n\n x  y  z w ▁ k", "▁", "word " * 500, "z" * 30_000, "a\x00b \x1c c", "  lead", "trail  "]


def words_of(text):
    return (text or "").encode().split()


# ---- exact dedup


def brute_exact(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\v\f\r"), []).append((-len(t or ""), i is None, i, k))
    out = {}
    for bare, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] if m[2] is not None else 0, m[3]))
        for m in members:
            out[m[3]] = (m[2], best[2], len(members), m[3] == best[3], hashlib.sha256(bare.encode()).hexdigest())
    return out


@pytest.mark.parametrize("most_bits", [1 << 29, 1 << 10])
def test_exact_dedup(spark, most_bits):
    rng = random.Random(3)
    texts = ODD + ["copy of a\ttext"] * 300 + ["copyofatext" + " " * k for k in range(9)] + [f"own {rng.random()}" for _ in range(400)] + ["pair  x", "pairx", "pair x"]
    ids = [None if k in (3, 40) else k + 10**12 for k in range(len(texts))]
    ids[-1] = ids[-2]
    want = brute_exact(list(zip(ids, texts)))
    df = table(spark, texts, ids).repartition(7)
    got = exact.report(df, most_bits=most_bits if most_bits > 1 << 20 else 1 << 12)
    assert Counter(map(tuple, got.collect())) == Counter(want.values())
    kept = exact.keep_first(df)
    assert kept.columns == df.columns
    pick = lambda r: (r["doc_id"], r["text"], r["a.b"])
    assert Counter(map(pick, kept.collect())) == Counter((ids[k], texts[k], "dot") for k, w in want.items() if w[3])


def test_exact_dedup_empty(spark):
    df = table(spark, []).where("doc_id > 0")
    assert exact.report(df).collect() == [] and exact.keep_first(df).collect() == []


def test_repeated_rows_keep_one(spark):
    got = exact.report(table(spark, ["sa me", "sa me", "same"], [4, 4, None])).collect()
    assert sorted((r.doc_id is None, r.keep_id, r.group_size, r.kept) for r in got) == [(False, 4, 3, False), (False, 4, 3, True), (True, 4, 3, False)]


def test_bloom_flags_all_repeats_and_few_others(spark):
    rows = spark.range(40_000).selectExpr("id", "xxhash64(CASE WHEN id < 300 THEN 7 WHEN id < 1000 THEN id % 350 ELSE id END, 'x') AS h")
    flagged = {r.id for r in exact.flagged(rows).where("maybe").collect()}
    counts = Counter(r.h for r in rows.collect())
    must = {r.id for r in rows.collect() if counts[r.h] > 1}
    assert must <= flagged and len(flagged - must) < 400


# ---- periodic runs


def brute_runs(x):
    n, out = len(x), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if x[i] != x[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and x[j] == x[j + p]:
                j += 1
            if j - i + p >= max(24, 3 * p):
                out.setdefault((i, j - i + p), p)
            i = j
    return sorted((s, length, p) for (s, length), p in out.items())


def periodic(rng, n, letters):
    x = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        p = rng.randint(1, 20)
        u = [rng.randrange(letters) for _ in range(p)]
        at = rng.randint(0, len(x))
        x[at:at] = (u * 8)[: rng.randint(3 * p, 8 * p)]
        if rng.random() < 0.3:
            x += x[rng.randint(0, len(x) - 1) :]
        if rng.random() < 0.2:
            x[rng.randrange(len(x))] = rng.randrange(letters)
    return x


def test_runs_equal_brute_force():
    rng, n = random.Random(1), 0
    for _ in range(1500):
        x = periodic(rng, rng.randint(0, 160), rng.choice((1, 2, 2, 3, 5)))
        want = brute_runs(x)
        assert runs.runs_of(x) == want and runs.text_runs([b"%d" % w for w in x]) == want
        n += len(want)
    assert n > 1000


def test_factors_occur_before():
    rng = random.Random(2)
    for _ in range(200):
        x, at = periodic(rng, 60, 3), 0
        for start, size, earlier in runs.factors(x):
            assert start == at and (earlier < 0 or x[earlier : earlier + size] == x[start : start + size] and earlier < start)
            longer = x[start : start + size + 1]
            assert len(longer) == size or not any(x[k : k + size + 1] == longer for k in range(start)) or earlier < 0 and x[start] not in x[:start]
            at += size
        assert at == len(x)


def brute_digest(i, text):
    words = words_of(text)
    n = len(words)
    if i is not None and n:
        h = zlib.crc32(str(i).encode())
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        if h % 10 == 0:
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    told = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_periodic_runs_query(spark):
    rng = random.Random(8)
    texts = ODD + [" ".join(f"w{k}" for k in periodic(rng, rng.randint(0, 200), 4)) for _ in range(150)]
    ids = [None if k == 5 else k for k in range(len(texts))]
    df = table(spark, texts, ids)
    got = [tuple(r) for r in runs.digest(runs.periodic_runs(runs.made_periodic(df))).collect()]
    assert Counter(got) == Counter(brute_digest(i, t) for i, t in zip(ids, texts))
    assert sum(r[1] > 0 for r in got) > 50 and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids if i is not None) > 5
    assert runs.periodic_runs(df.where("doc_id < 0")).collect() == []


def test_periodic_runs_on_table(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").collect()
    got = {tuple(r) for r in queries.op12_periodic_runs(spark, D).collect()}
    assert got == {brute_digest(r.doc_id, r.text) for r in docs}


# ---- alignment


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(queries.vocabulary_path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary_path("piece_bpe_32k.model"))
    one.encode_special_tokens = True
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    linked, count = [], Counter()
    for i, text in rows:
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids
        b = two.encode(text or "")
        bytes_a = [bytes(letter[c] for c in one.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if two.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [two.id_to_piece(x)]]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            linked.append((i, 0, 0, [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links = [(a[k], b[j]) for k, e in enumerate(ends_a) for j in ([ends_b.index(e)] if e in set(ends_b) else [])]
        groups, p, q = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(",".join(map(str, a[p:x])) + "|" + ",".join(map(str, b[q:y])))
            p, q = x, y
        count.update(links)
        linked.append((i, len(a), len(b), links, ";".join(groups)))
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    rows = [(i, na, nb, len(links), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, na, nb, links, g in linked]
    return rows, {(a, b): (n, n == top[b]) for (a, b), n in count.items()}


def test_alignment(spark, monkeypatch):
    monkeypatch.setattr(alignment, "_CHUNKS", 2)  # several tasks a stripe
    rng = random.Random(4)
    texts = ODD + ["hot words, repeated. " * 40] * 30 + [" ".join(rng.choice(("the", "house", "Straße", "naïve?", "x=y(1);", "\n", "12345", "don't", "—")) for _ in range(rng.randint(0, 80))) for _ in range(80)]
    ids = [None if k == 6 else k for k in range(len(texts))]
    ids[-1] = ids[-2]
    paths = [queries.vocabulary_path(x) for x in queries.ALIGNED]
    got, pairs = alignment.align(table(spark, texts, ids).repartition(6), *paths, stripes=16)
    rows, counts = brute_alignment(list(zip(ids, texts)))
    assert Counter(map(tuple, got.collect())) == Counter(rows)
    assert {(r.a, r.b): (r.n, r.best) for r in pairs.collect()} == counts
    plain, _ = alignment.align(table(spark, texts[:9]), *paths, hashed=False)
    assert {r.doc_id: hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "" for r in plain.collect()} == {r[0]: r[-1] for r in brute_alignment(list(enumerate(texts[:9])))[0]}
    assert alignment.align(table(spark, []).where("doc_id > 0"), *paths)[0].collect() == []


def test_alignment_on_table(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").collect()
    got = {tuple(r) for r in queries.op11_alignment(spark, D).collect()}
    assert got == set(brute_alignment([(r.doc_id, r.text) for r in docs])[0])


def test_units_forgotten(monkeypatch):
    monkeypatch.setattr(alignment, "_MOST", 50)
    pair = alignment.Aligner(*[queries.vocabulary_path(x) for x in queries.ALIGNED])
    one = alignment.Aligner(*[queries.vocabulary_path(x) for x in queries.ALIGNED])
    rng = random.Random(5)
    for _ in range(60):
        text = " ".join(f"w{rng.randrange(400)}" for _ in range(30)) + " " + "long" * 30
        monkeypatch.setattr(alignment, "_MOST", 50)
        a = pair.align(text)
        monkeypatch.setattr(alignment, "_MOST", 10**6)
        assert a == one.align(text)


# ---- pipeline


def test_stages_keep_foreign_columns(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    rng = random.Random(6)
    text = lambda k: " ".join(f"word{rng.randrange(900)}" for _ in range(60)) + f" {k}"
    rows = [(k, text(k), "en", f"s{k % 3}", None) for k in range(40)] + [(40, None, "en", None, None), (41, "", None, "s1", None), (None, "short", "en", "s1", None)]
    names = ["_id", "_copy", "_gone", "a.b", "row", "id", "taken", "times", "copy", "keep", "text2"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    docs = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce("doc_id", F.lit(-1))).alias(c) for c in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns, name
        held = out.collect()
        assert held or name == "quality classifier"
        for r in held:
            assert [r[c] for c in names] == [f"{c}:{-1 if r.doc_id is None else r.doc_id}" for c in names], name
        assert stage(spark, docs.limit(0), D).count() == 0
        if name == "simhash near-dedup":
            assert Counter(r.doc_id for r in held) == Counter([*range(41), None])  # 41 is as empty as 40
        if name == "source mixing":
            assert {r.doc_id for r in held} == {*range(42), None}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, D).collect()
    assert {r.doc_id for r in packed} == {*range(42), None}


# ---- pages


def text_of(html, *others):
    lines = pages.lines_of(html)
    own = [t for _, t in lines]
    frame = pages.frame_lines(own, [[t for _, t in pages.lines_of(o)] for o in others])
    return pages.main_text("".join(f for f, _ in lines), own, frame)


def test_teasers_are_not_the_story():
    story = "<div id=content><h1>Title</h1><p>The long story.</p></div><article class=teaser>Related card</article>"
    assert text_of(story) == "Title\nThe long story.\nRelated card"
    assert text_of(story, "<div><h1>Other</h1></div><article class=teaser>Related card</article>") == "Title\nThe long story."
    assert text_of("<p>Site of news</p><article><p>A story that is longer.</p></article>") == "A story that is longer."


def test_words_within_lines_stay():
    assert text_of("<article><p>Set the <label>Speed</label> dial</p></article>") == "Set the Speed dial"
    assert text_of('<article><p>See <span id="comment">this remark</span> twice</p></article>') == "See this remark twice"
    assert text_of('<article><p>Text here</p><form><label>Mail</label><input></form><div class="comment">Nice one</div></article>') == "Text here"


def test_deep_pages_hide_too():
    deep = "<div>" * 5000
    assert text_of(f"{deep}<nav>Menu</nav><article><p>Deep text</p></article>") == "Deep text"
    assert text_of("<i></b>" * 20_000 + "<p>a<p>b") == "a\nb"
