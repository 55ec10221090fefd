"""The corpus operators against brute force, on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import re
import zipfile
import zlib
from glob import glob

import numpy as np
import pytest
import xxhash

from vecloom.llm import embeddings, fingerprint, mih, mixing, packing, pages, quality, templates, tokens, warc
from vecloom.llm.common import components, scratch_path
from vecloom.llm.queries import vocabulary_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, epoch int, line int, keep string"


def docs(spark, texts, ids=None, source=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", source[k] if source else "s", 0 if t is None else len(t), 7, "x", 1, 2, "y") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[k]}{j}" for k, j in zip(rng.integers(0, 12, n), rng.integers(0, 50, n)))


ODD = [None, "", " \n\t ", "one", "one", "A b C", prose(1), prose(1), prose(2), "z" * 50_000, "é ü ß 漢字 <|endoftext|> don't 12", prose(3, 30_000)]


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(k, k + 1) for k in range(200, 260)]
    want = union(261, pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: want[k] for k in got} and all(want[k] == k for k in range(261) if k not in got)


def test_embedding_pairs(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((150, 16))
    x = np.concatenate([base, base[:80] + 0.05 * rng.standard_normal((80, 16)), base[:3], np.repeat(base[5:6], 300, 0) + 0.02 * rng.standard_normal((300, 16))])
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [None] + [1.0] * 15, 1), (1003, [float("nan")] + [1.0] * 15, 1), (1004, [], 1), (1005, [1.0, 2.0], 1), (1006, [2.0, 4.0], 1)]
    got = {r.vec_id: r for r in embeddings.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    want = union(len(x), np.argwhere(near).tolist())
    links = np.array([got[k].n_links for k in range(len(x))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.97 * near.sum()
    assert np.mean([got[k].component_id == want[k] for k in range(len(x))]) > 0.97
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(1000, 1005))
    assert got[1005].n_links == 1 and got[1006].component_id == 1005
    assert embeddings.near_dedup(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_edit_report(spark):
    got = {r.doc_id: r for r in fingerprint.edit_report(docs(spark, ODD)).collect()}
    texts = [t or "" for t in ODD]
    for k, t in enumerate(texts):
        nxt, half = texts[(k + 1) % len(texts)], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[k].n_chars == len(t) and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
    assert got[6].fingerprint == got[7].fingerprint and got[6].near_next == 1
    assert fingerprint.edit_report(docs(spark, [])).count() == 0
    assert fingerprint.edit_report(docs(spark, ["a b c", "d e", "f"], ids=[None, 4, 4])).count() == 3


def test_permuted_tables(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2, (40, 128))
    flips = base.copy()
    for r in range(40):
        flips[r, rng.choice(128, r % 6, replace=False)] ^= 1
    bits = np.concatenate([base, flips])
    fps = [[int("".join(map(str, b[k : k + 64])), 2) for k in (0, 64)] for b in bits]
    signed = [[x - 2**64 if x >= 2**63 else x for x in f] for f in fps]
    got = {(r.a, r.b) for r in fingerprint.permuted_table_links(spark.createDataFrame(list(enumerate(signed)), "id long, fp array<long>"), radius=3).collect()}
    d = (bits[:, None, :] != bits[None, :, :]).sum(2)
    first = {tuple(f): min(k for k, g in enumerate(fps) if g == f) for f in fps}
    reps = sorted(first.values())
    assert got == {(a, b) for a in reps for b in reps if a < b and d[a, b] <= 3}


def page_rows():
    long = "<html><body><nav>Menu</nav><article><p>Hello &amp; <b>you</b></p></article></body></html>" + " " * 1000
    return [(1, "http://a.b/c", long), (2, "http://a.b/d é", long), (3, None, long), (4, "x", "short"), (5, "y", "short"), (6, "z", None), (7, "q", ""), (None, "n", long), (9, "m", "<p>" + "w " * 60_000)]


@pytest.mark.parametrize("zip64", [False, True])
def test_archives(spark, zip64):
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string").repartition(2)
    path = scratch_path(spark, "test")
    warc.write(df, path, member=2000, zip64=zip64)
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    assert set(got) == {r[0] for r in page_rows()}
    for i, url, html in page_rows():
        data = (html or "").encode()
        r = got[i]
        assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha1(data).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", 3) if i in (1, 2, None) else ("response", None))
        assert r.payload == (None if r.record_type == "revisit" else data)
    for name in glob(path.removeprefix("file://") + "/part-*"):
        with zipfile.ZipFile(name) as z:
            assert z.testzip() is None and len(z.namelist()) % 2 == 0
    assert warc.round_trip(df.limit(0)).count() == 0


def test_mixing_targets(spark):
    source = ["a"] * 60 + ["b"] * 12 + ["c"] * 6 + [None] * 2
    df = docs(spark, [f"w{k} " * 10 for k in range(80)], source=source)
    table = mixing.token_table(df, "doc_id", "source", "text")
    got = mixing.mix(table, max_repeats=100.0).toPandas()
    have = {"a": 600, "b": 120, "c": 60, "": 20}
    p = np.array(list(have.values())) / 800
    entropy = lambda q: -(q * np.log(q)).sum()
    w = got.groupby("source").n_tokens.sum().reindex(list(have)).to_numpy()
    want = (entropy(p) + np.log(4)) / 2
    assert abs(entropy(w / w.sum()) - want) < 0.03 and abs(w.sum() - 800) <= 40
    again = mixing.mix(table, max_repeats=100.0).toPandas()
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, again.to_numpy().tolist()))
    for (_, _), g in got.groupby(["source", "epoch"]):
        g = g.sort_values("start")
        assert (g.start.diff().dropna() == 10).all()
    rows = mixing.mixed_rows(df, max_repeats=1.5)
    assert rows.columns == df.columns
    n = rows.groupBy("doc_id").count().toPandas()["count"]
    assert len(n) == 80 and n.max() == 2
    odd = mixing.mixed_rows(docs(spark, ODD, ids=[0, 1, 2, 3, 3, None, 6, 7, 8, 9, 10, 11]))
    assert odd.select("text").distinct().count() == len(set(ODD))
    assert mixing.mixed_rows(docs(spark, [])).count() == 0 and mixing.mix(mixing.token_table(docs(spark, []), "doc_id", "source", "text")).count() == 0


def test_token_counts_and_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary_path())
    df = docs(spark, ODD)
    ids = {k: tok.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(ODD)}
    got = {r.doc_id: r for r in tokens.count_tokens(df, vocabulary_path()).collect()}
    assert {k: r.n_tokens for k, r in got.items()} == {k: len(x) for k, x in ids.items()}
    assert all(r.n_bytes == len((ODD[k] or "").encode()) and r.over_limit == (r.n_tokens > 2048) for k, r in got.items())
    whole = tokens.whole_tokens(vocabulary_path())
    some = list(whole)[:500]
    assert all(tok.encode(s, add_special_tokens=False).ids == [whole[s]] for s in some)

    pieces = packing.digest(packing.pack(df.repartition(2), vocabulary_path())).toPandas()
    taken = {k: [] for k in ids}
    for r in pieces.itertuples():
        own = (ids[r.doc_id] + [2])[r.start : r.start + r.length]
        assert zlib.crc32(np.array(own, dtype="<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) + 1
        taken[r.doc_id].append((r.start, r.length))
    for k, parts in taken.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[k]) + 1
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.cumsum([0, *g.length])[:-1]).all()
        n = g.length.sum()
        assert n == 4096 or n < 4096 and n & (n - 1) == 0
    assert packing.pack(docs(spark, []), vocabulary_path()).count() == 0


@pytest.mark.parametrize("most", [400_000, 33_330])
def test_ids_of_random_texts(monkeypatch, most):
    """As the library's, also where the memory of words is nearly always full."""
    monkeypatch.setattr(tokens, "_MOST", most)
    counter = tokens.Counter(vocabulary_path())
    rng = np.random.default_rng(5)
    alphabet = np.array(list("abcdeABCDE aeiou  \n\t\r''stlvemrd.,;-<|>019ÀéßñœŒžĦ") + ["<|endoftext|>", "'s", "'LL", "ŉ", "漢", "é", "K", "İ", "\u00a0", "\x1c", "x" * 150])
    rare = len(alphabet) - 8  # these end the plain texts
    for k in range(600):
        text = "".join(rng.choice(alphabet[:rare] if k % 2 else alphabet, rng.integers(0, 300)))
        want = counter.tok.encode(text, add_special_tokens=False).ids
        assert counter.ids(text) == np.array(want, dtype="<u4").tobytes(), text
        assert len(counter.known) <= most
    counter.forget()
    assert len(counter.known) == len(counter.known.whole)


def test_packer_stays_bounded():
    p, out = packing.Packer(64), 0
    for k in range(5000):
        out += sum(len(x[2]) // 4 for w in p.add(k, bytes(4 * 40)) for x in w)
        assert p.n_open <= 1024
    out += sum(len(x[2]) // 4 for w in p.finish() for x in w)
    assert out == 5000 * 40


def test_line_dedup(spark):
    note = "Copyright 2024 by the authors of this page"
    texts = [f"{prose(k, 12)}\n{note.replace('2024', str(2000 + k))}\nerror in module part{chr(97 + k)} at line nine of this file" for k in range(6)] + [None, "", "short one", prose(1, 12)]
    got = {r.doc_id: r for r in templates.report(docs(spark, texts)).collect()}
    assert got[0].n_dropped == 0 and got[0].kept_text == texts[0]
    for k in range(1, 6):
        assert got[k].kept_text == texts[k].split("\n")[0]
    assert got[6].kept_text is None and got[7].kept_text == "" and got[9].kept_text == texts[9]
    same = templates.report(docs(spark, ["a b c d"] * 4, ids=[1, 1, 1, 1])).collect()
    assert all(r.n_dropped == 0 for r in same)
    out = templates.dedup_lines(docs(spark, ODD, ids=[None, 1, 2, 3, 3, 5, 6, 7, 8, 9, 10, 11]))
    assert out.count() == len(ODD) and out.columns == docs(spark, ODD).columns
    assert templates.dedup_lines(docs(spark, [])).count() == 0


def test_pipeline_drops_repeated_lines_without_template(spark):
    import corpus_pipeline

    lines = ["Posted on 2024-01-05 at 13:22", "Tel 555-0101 Fax 555-0102", "Chapter 12 ends", "Read more", "Home"]
    texts = ["\n".join([f"{WORDS[k]} {WORDS[k + 3]} {WORDS[k + 6]}", *lines, "", f"{k} {k + 1} {k + 2}"]) for k in range(3)] + ["Home \n  Read  more\r", "Once 1"]
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_template_lines(spark, docs(spark, texts), "").collect()}
    assert got[0] == texts[0] and got[4] == texts[4] and got[3] == ""
    assert got[1] == "beta epsilon theta\n\n1 2 3" and got[2] == "gamma zeta iota\n\n2 3 4"
    twice = corpus_pipeline.drop_template_lines(spark, docs(spark, ["a 1\nRead more", "b 2\nRead more"]), "").collect()
    assert sorted(r.text for r in twice) == ["a 1\nRead more", "b 2\nRead more"]


def test_pipeline_drops_long_lines_of_two_documents(spark):
    import corpus_pipeline

    long, short = (" ".join(f"{WORDS[j % 12]}x" for j in range(n)) for n in (50, 49))
    texts = [f"a 1\n{long}\n{short}", f"b 2\n{long}\n{short}"]
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_template_lines(spark, docs(spark, texts), "").collect()}
    assert got == {0: texts[0], 1: f"b 2\n{short}"}


def test_quality_held_out(spark):
    good = [prose(k) + "." for k in range(200)]
    bad = [prose(k).upper().replace(" ", "!! ") for k in range(100)] + [" ".join([w] * 20) for w in WORDS * 4]
    df = docs(spark, good + bad + ODD, source=(["a", "b", None] * 200)[: 200 + len(bad) + len(ODD)])
    labels = spark.createDataFrame([(k, int(k < 200), 0) for k in range(0, 200 + len(bad), 2)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.report(df, labels).collect()}
    held = [k for k in range(200 + len(bad)) if k % 2]
    assert np.mean([got[k].keep == (k < 200) for k in held]) > 0.97
    assert len(got) == 200 + len(bad) + len(ODD) and all(0 < r.p_quality < 1 for r in got.values())
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns
    assert quality.report(docs(spark, []), labels).count() == 0
    assert quality.report(docs(spark, ["a b"]), labels.limit(0)).count() == 1


def test_page_text(spark):
    frame = '<nav><a href="/">Home</a></nav><div class="ad">Buy</div>{}<aside>More</aside><form><input>Go</form><section id="comments"><p>First!</p></section><footer>&copy; me</footer>'
    article = "<article><h1>Title &amp; more</h1><p>One\n two<br>three<p>Last</p><script>x('</p>')</script></article>"
    plain = "<div>Site name</div><div>Text of page {}</div><div>All rights reserved</div>"
    rows = [(1, "http://h/a", frame.format(article)), (2, "http://h/b", frame.format(article)), (3, "http://p/x/1", plain.format(1)), (4, "http://p/x/2", plain.format(2)), (5, "nohost", plain.format(3)), (6, None, None), (7, "http://q/", "<p>unclosed <b>bold")]
    got = {r.page_id: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == got[2].text == "Title & more\nOne two three\nLast" and got[1].n_chars == len(got[1].text)
    assert got[3].text == "Text of page 1" and got[4].text == "Text of page 2"
    assert got[5].text == "Site name\nText of page 3\nAll rights reserved" and got[6].text == "" and got[7].text == "unclosed bold"
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    many = [(k, f"http://h/{k:03d}", plain.format(k)) for k in range(60)]
    assert {r.page_id: r.text for r in pages.extract(spark.createDataFrame(many, "page_id long, url string, html string").repartition(5)).collect()} == {k: f"Text of page {k}" for k in range(60)}


@pytest.mark.parametrize("page", [
    "<main class='content no-sidebar'><p>The text</p></main>", "<div class='content with-sidebar'><p>The text</p></div>", "<article class='post comments-open'>The text</article>",
    "<div class='story social-science'>The text</div>", "<div class='widget'><nav>Menu</nav><div class='ad'>Buy</div><article>The text</article></div><div class='ad'>Buy</div>", "<html><head><title>x</title><body><p>The text</p>",
])
def test_class_words_leave_articles(page):
    found = pages.lines_of(page)
    assert pages.main_text("".join(f for f, _ in found), [x for _, x in found]) == "The text"


def test_shared_lines():
    assert pages.shared_lines(list("abcxd"), list("axbcd")) == {0, 1, 2, 4}
    assert pages.shared_lines(["a"] * 3, ["a"] * 2) == {0, 1}
    assert pages.shared_lines([], ["a"]) == set()


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_classes(spark):
    texts = ODD[:-1] + [prose(2) + " end", prose(9, 400), prose(9, 399)]
    got = {r.doc_id: r for r in mih.near_dedup(docs(spark, texts)).collect()}
    fp = [brute_simhash(t) for t in texts]
    want = union(len(fp), [(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 2])
    assert [got[k].fingerprint for k in range(len(fp))] == [f"{x:016x}" for x in fp]
    assert [got[k].component_id for k in range(len(fp))] == want
    assert mih.near_dedup(docs(spark, [])).count() == 0
    some = mih.near_dedup(docs(spark, ["a", "a", "b"], ids=[None, 5, None])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in some) == [("5", "5"), ("None", "5"), ("None", "None")]


@pytest.mark.parametrize("segments,radius", [(2, 2), (4, 5), (3, 3)])
def test_multi_index_finds_all(spark, segments, radius):
    rng = np.random.default_rng(segments)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 60)]
    fps = set(base)
    for x in base:
        for n in range(1, radius + 3):
            y = x & (2**64 - 1)
            for b in rng.choice(64, n, replace=False):
                y ^= 1 << int(b)
            fps.add(y - 2**64 if y >= 2**63 else y)
    fps = sorted(fps)
    df = spark.createDataFrame([(k, [x]) for k, x in enumerate(fps)], "id long, fp array<long>")
    got = {(r.a, r.b) for r in mih.hamming_links(df, 1, segments, radius).collect()}
    near = {(a, b) for b in range(len(fps)) for a in range(b) if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= radius}
    assert got == near


def test_keep_one_recall(spark):
    rng = np.random.default_rng(8)
    texts, gone = [], []
    for k in range(60):
        words = prose(1000 + k, 200).split()
        texts.append(" ".join(words))
        near = list(words)
        for at in rng.choice(200, 2, replace=False):
            near[at] = "changed"
        gone.append(len(texts))
        texts.append(" ".join(near))
        half = words[:100] + prose(5000 + k, 100).split()
        texts.append(" ".join(half))
    kept = {r.doc_id for r in mih.keep_one(docs(spark, texts)).collect()}
    assert np.mean([k not in kept for k in gone]) >= 0.95
    assert all(k in kept for k in range(len(texts)) if k not in gone)
    assert mih.keep_one(docs(spark, [])).count() == 0


def jaccard(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_keep_one_spares_families(spark):
    rng = np.random.default_rng(11)
    base, texts = prose(77, 300).split(), []
    for k in range(60):
        at = int(rng.integers(0, 267))
        texts.append(" ".join(base[:at] + [f"own{k}x{j}" for j in range(33)] + base[at + 33 :]))
    pairs = [(a, b) for b in range(60) for a in range(b) if jaccard(texts[a], texts[b]) >= 0.8]
    want = union(60, pairs)
    assert sorted(r.doc_id for r in mih.keep_one(docs(spark, texts)).collect()) == [k for k in range(60) if want[k] == k]


@pytest.mark.parametrize("least", [0.80, 0.85])
def test_keep_one_recall_near_the_limit(spark, least):
    texts, gone = [], []
    for k in range(100):
        words, new = prose(20_000 + k, 300).split(), [f"own{k}x{j}" for j in range(120)]
        texts.append(" ".join(words))
        changed = [lambda n: words + new[:n], lambda n: words[:100] + new[:n] + words[100 + n :]][k % 2]
        n = max(n for n in range(1, 120) if jaccard(texts[-1], " ".join(changed(n))) >= least)
        gone.append(len(texts))
        texts.append(" ".join(changed(n)))
    kept = {r.doc_id for r in mih.keep_one(docs(spark, texts)).collect()}
    assert np.mean([k not in kept for k in gone]) >= 0.98
    assert all(k in kept for k in range(len(texts)) if k not in gone)


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    data = spark.read.parquet(d + "/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch_path(spark, "stage")
        stage(spark, data, d).write.parquet(path)
        data = spark.read.parquet(path)
        assert data.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert data.where("n_chars <> char_length(text)").count() == 0
    assert corpus_pipeline.run(spark, d).count() > 0
