"""The corpus operators against second, plain implementations, on hot groups, clashing columns and both sides of each limit."""

import math
import os
import random

import numpy as np
import pytest

from vecloom import session
from vecloom.llm import embeddings, fingerprint, mih, packing, pages, quality, templates, tokens, warc
from vecloom.llm.common import cells, scratch_path
from vecloom.llm.queries import vocabulary_path

from .test_operators import ODD, docs, prose, union

SF = "/root/testdata/sf0.01"
M = (1 << 64) - 1


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError):
            session.shared_dir(spark)


def test_cells_meet_each_pair_once(spark):
    rows = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(99, 5)], "id long, g int")
    got = {}
    for r in cells(rows, ["g"], 7).collect():
        got.setdefault((r.g, r.i, r.j), []).append((r.id, r.own))
    met = [(a, b) for (_, i, j), x in got.items() for a, p in x for b, q in x if a < b and (i == j or p != q)]
    assert sorted(met) == sorted((a, b) for a in range(60) for b in range(a + 1, 60) if a % 2 == b % 2)


# ---- op1


def planted(n, pairs, dim=32, cosine=0.9505, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((pairs, dim))
    side -= (side * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return np.concatenate([x, cosine * x[:pairs] + math.sqrt(1 - cosine**2) * side])


def vectors(spark, x):
    return spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")


def test_recall_of_pairs_near_the_threshold(spark):
    x = planted(4000, 400)
    got = {r.vec_id: r for r in embeddings.near_dedup(vectors(spark, x)).collect()}
    hits = [got[k].n_links >= 1 and got[4000 + k].component_id == got[k].component_id for k in range(400)]
    assert np.mean(hits) >= 0.99
    far = {r.vec_id: r.n_links for r in embeddings.near_dedup(vectors(spark, planted(300, 100, cosine=0.9495))).collect()}
    assert not any(far.values())


@pytest.mark.parametrize("leading,passes", [(2, 10), (4, 23), (None, None)])
def test_hot_groups_count_all_links(spark, leading, passes):
    """Runs far beyond the window and blocks, and windows alone: the counts are those of all pairs."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal(24) + 0.22 * rng.standard_normal((700, 24)), rng.standard_normal((100, 24)), np.repeat(rng.standard_normal((1, 24)), 40, 0)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    assert 0.2 < near[:700, :700].mean() < 0.99
    got = {r.vec_id: r for r in embeddings.near_dedup(vectors(spark, x), leading=leading, passes=passes).collect()}
    links = np.array([got[k].n_links for k in range(len(x))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.98 * near.sum() and (links[800:] == 39).all()
    want = union(len(x), np.argwhere(near).tolist())
    assert np.mean([got[k].component_id == want[k] for k in range(len(x))]) > 0.99


def test_passes_grow_with_the_table():
    plans = [embeddings.plan_passes(n) for n in (0, 1000, 10**5, 10**6, 10**8, 10**10)]
    assert plans == sorted(plans) and plans[0][0] == 3 and all(n <= 16 * 32**lead for n, (lead, _) in zip((0, 1000, 10**5, 10**6, 10**8, 10**10), plans))


def test_embeddings_without_and_with_repeated_ids(spark):
    v = [1.0, 0.0, 0.0]
    rows = [(None, v), (7, v), (7, [0.0, 1.0, 0.0]), (None, [0.0, 0.0, 1.0]), (9, [0.99, 0.01, 0.0]), (3, None)]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embeddings.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == sorted([("None", 2, "7", False), ("7", 2, "7", True), ("9", 2, "7", False), ("7", 0, "7", True), ("None", 0, "None", False), ("3", 0, "3", True)])


# ---- op2


def plain_fingerprint(text):
    """128 bits with Python integers, term by term, and the bits whose votes are so near a tie that rounding decides."""
    base, m1, m2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

    def mix(x, salt=0):
        x = (x + salt * base) & M
        x = ((x ^ (x >> 30)) * m1) & M
        x = ((x ^ (x >> 27)) * m2) & M
        return x ^ (x >> 31)

    words = [w for w in text.encode().lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()]
    hashes = [mix((sum((c + 1) * pow(base, k, 1 << 64) for k, c in enumerate(w)) + len(w)) & M) for w in words]
    size = min(2, len(hashes))
    terms = {}
    for k in range(len(hashes) - size + 1 if hashes else 0):
        h = 0
        for w in hashes[k : k + size]:
            h = mix((h * base + w) & M)
        terms[h] = terms.get(h, 0) + 1
    total = sum(1 + math.log(n) for n in terms.values())
    out, ties = [], []
    for word in (1, 2):
        ones = [sum((1 + math.log(n)) * (mix(h, word) >> (63 - b) & 1) for h, n in terms.items()) for b in range(64)]
        out.append(sum(1 << (63 - b) for b in range(64) if 2 * ones[b] > total))
        ties.append(sum(1 << (63 - b) for b in range(64) if total and abs(2 * ones[b] - total) < 1e-9))
    return (out[0] << 64) + out[1], (ties[0] << 64) + ties[1]


def same_fingerprint(found, text):
    bits, ties = plain_fingerprint(text)
    return (int(found, 16) ^ bits) & ~ties == 0


def test_fingerprints_and_radius_by_brute_force(spark):
    base = prose(1, 80)
    near = [" ".join(base.split()[:k] + ["own"] + base.split()[k + 1 :]) for k in (10, 30, 79)]
    texts = [base, *near, base, None, "", "one", "One", "a b a b a b", prose(2, 40), prose(3, 300), "\x0b x\x0cy "]
    got = {r.doc_id: r for r in fingerprint.edit_report(docs(spark, texts), radius=12).collect()}
    assert all(same_fingerprint(got[k].fingerprint, t or "") for k, t in enumerate(texts))
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    like = lambda a, b: max(0.0, math.cos(math.pi * apart(a, b) / 128))
    for k, t in enumerate(texts):
        inside = [j for j in range(len(texts)) if apart(got[k].fingerprint, got[j].fingerprint) <= 12]
        assert (got[k].n_within, got[k].first_within) == (len(inside), min(inside)), k
        t, after = t or "", (k + 1) % len(texts)
        half = len(t) // 2
        assert same_fingerprint(got[k].edited_fingerprint, t[: len(t) - half] + (texts[after] or "")[:half])
        assert abs(got[k].near_edited - like(got[k].fingerprint, got[k].edited_fingerprint)) < 1e-12 and abs(got[k].near_next - like(got[k].fingerprint, got[after].fingerprint)) < 1e-12


def test_edit_report_by_ranges(spark):
    """Many small ranges give what one gives; null ids come first, repeated ids in the order of their texts."""
    texts, ids = [f"{prose(k, 5)} {k}" for k in range(40)], [None, None, 5, 5, *range(6, 42)]
    order = sorted(range(40), key=lambda k: (ids[k] is not None, ids[k] or 0, texts[k]))
    n = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        got = sorted((str(r.doc_id), r.edited_sha256) for r in fingerprint.edit_report(docs(spark, texts, ids=ids).repartition(5)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    import hashlib

    want = []
    for at, k in enumerate(order):
        t, nxt = texts[k], texts[order[(at + 1) % 40]]
        half = len(t) // 2
        want.append((str(ids[k]), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert got == sorted(want)


def test_hot_block_sums(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2, 128)
    bits = np.repeat(base[None], 1300, 0)
    for r in range(1300):
        bits[r, rng.choice(128, r % 4, replace=False)] ^= 1
    fps = [[int("".join(map(str, b[k : k + 64])), 2) for k in (0, 64)] for b in bits]
    rows = [(k, [x - 2**64 if x >= 2**63 else x for x in f]) for k, f in enumerate(fps)]
    got = {tuple(r.fp): (r.n_within, r.first_within) for r in fingerprint.within_radius(spark.createDataFrame(rows, "id long, fp array<long>")).collect()}
    d = bits.astype(np.int32)
    apart = d.sum(1)[:, None] + d.sum(1)[None] - 2 * d @ d.T
    for k in range(1300):
        inside = np.flatnonzero(apart[k] <= 3)
        assert got[tuple(rows[k][1])] == (len(inside), inside[0])


# ---- op3


def test_archives_with_clashing_columns(spark):
    long = "<p>" + "x" * 2000
    rows = [(k % 3 if k % 4 else None, f"http://h/{k}", long if k % 2 else None, "d", "f", "m", "v") for k in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, first string, match string, value string")
    path = scratch_path(spark, "clash")
    warc.write(df, path)
    for ranged in (True, False):
        got = warc.read(spark, path, ranged=ranged).toPandas()
        assert len(got) == 12 and (got.payload_bytes.sort_values() == sorted([0] * 6 + [2003] * 6)).all()
        assert set(got[got.record_type == "revisit"].refers_to) == {2.0}
        assert (got.record_type == "response").sum() == 6 + sum(1 for r in rows if r[0] == 2 and r[2])


# ---- op5, op9


def test_tokens_and_pieces_of_repeated_ids(spark):
    df = docs(spark, ["a b", "c", None, "d e f", "d e f"], ids=[1, 1, None, None, 2])
    got = tokens.count_tokens(df, vocabulary_path())
    assert got.count() == 5 and tokens.count_tokens(df.limit(0), vocabulary_path()).count() == 0
    pieces = packing.digest(packing.pack(df, vocabulary_path())).toPandas()
    assert pieces.length.sum() == got.toPandas().n_tokens.sum() + 5 and pieces.doc_id.isna().sum() >= 2


@pytest.mark.parametrize("most", [1, 3, 1024])
def test_packing_at_any_bound(monkeypatch, most):
    monkeypatch.setattr(packing, "_OPEN", most)
    rng = np.random.default_rng(most)
    p, seen, full = packing.Packer(64), {}, 0
    sizes = [int(n) for n in rng.integers(1, 150, 400)]

    def take(windows, last=False):
        nonlocal full
        for w in windows:
            n = sum(len(x[2]) // 4 for x in w)
            full += n == 64
            assert n == 64 or last and n & (n - 1) == 0
            for doc, start, ids, total in w:
                assert np.frombuffer(ids, "<u4").tolist() == list(range(start, start + len(ids) // 4)) and total == sizes[doc]
                seen.setdefault(doc, []).append((start, len(ids) // 4))

    for k, n in enumerate(sizes):
        take(p.add(k, np.arange(n, dtype="<u4").tobytes()))
        assert p.n_open <= most
    take(p.finish(), last=True)
    for k, n in enumerate(sizes):
        at = 0
        for start, length in sorted(seen[k]):
            assert start == at
            at += length
        assert at == n


# ---- op6


def test_lines_without_template_and_clashing_columns(spark):
    long = " ".join(f"word{chr(97 + k % 26)}" for k in range(50))
    texts = [f"Home\nCall 555-01 12 7\n{prose(k, 8)}\n{long if k < 2 else 'x'}" for k in range(3)]
    df = spark.createDataFrame([(k, t, "g", "t", k, "r") for k, t in enumerate(texts)], "doc_id long, text string, gone string, row string, n int, id string")
    got = {r.doc_id: r for r in templates.dedup_lines(df).collect()}
    assert got[0].text == texts[0] and got[1].text == prose(1, 8) and got[2].text == f"{prose(2, 8)}\nx"
    assert all((r.gone, r.row, r.n, r.id) == ("g", "t", k, "r") for k, r in got.items())
    many = ["\n".join(f"line {chr(97 + a)}{chr(97 + b)} of text" for a in range(26) for b in range(26)) + f"\nown{k} line" for k in range(3)]
    kept = {r.doc_id: r.kept_text for r in templates.report(docs(spark, many)).collect()}
    assert kept == {0: many[0], 1: "own1 line", 2: "own2 line"}


def test_hot_leaf_in_salts(spark, monkeypatch):
    texts = [f"the same three words then own{chr(97 + k % 26)}{chr(97 + k // 26)} word in a longer line" for k in range(60)]
    want = sorted(map(tuple, templates.report(docs(spark, texts)).collect()))
    assert sum(r[2] for r in want) == 59
    monkeypatch.setattr(templates, "_SALTED", 7)
    assert sorted(map(tuple, templates.report(docs(spark, texts)).collect())) == want


# ---- op7


def test_posteriors_by_brute_force(spark):
    texts = [prose(k, 30) if k % 3 else prose(k, 30).upper().replace(" ", "!! ") for k in range(120)]
    rows = [(k, t, ["a", "b", None][k % 7 % 3], ["x", "y"][k % 2], "k", 0.5, "h", "p") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, keep string, p_path double, host string, row string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(0, 120, 2)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.report(df, labels).collect()}
    p = np.array([got[k].p_doc for k in range(120)])
    place = [(r[2] or "", r[3]) for r in rows]
    overall = p.mean()

    def strength(groups):  # (n, mean, around)
        n, r, m = (np.array(x) for x in zip(*groups))
        between = max(((n * (r - m) ** 2).sum() - (m * (1 - m)).sum()) / n.sum(), 1e-9)
        return min(max((n * m * (1 - m)).sum() / n.sum() / between - 1, 1.0), 10_000.0)

    hosts = {h: [k for k in range(120) if place[k][0] == h] for h in {h for h, _ in place}}
    c = strength([(len(x), p[x].mean(), overall) for x in hosts.values()])
    p_host = {h: (p[x].sum() + c * overall) / (len(x) + c) for h, x in hosts.items()}
    paths = {q: [k for k in range(120) if place[k] == q] for q in set(place)}
    d = strength([(len(x), p[x].mean(), p_host[q[0]]) for q, x in paths.items()])
    logit = lambda q: np.log(q / (1 - q))
    for q, x in paths.items():
        p_path = (p[x].sum() + d * p_host[q[0]]) / (len(x) + d)
        for k in x:
            want = 1 / (1 + np.exp(-(logit(p[k]) - logit(overall) + logit(p_path))))
            assert np.allclose((got[k].p_host, got[k].p_path, got[k].p_quality), (p_host[q[0]], p_path, want), rtol=1e-9)
            assert got[k].keep == (want >= 0.5)
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and {tuple(r) for r in kept.collect()} == {rows[k] for k in range(120) if got[k].keep}
    assert quality.keep_good(df.limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_labels(spark):
    df, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    seen = labels.where("doc_id % 2 = 0")
    held = {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    got = {r.doc_id: r.keep for r in quality.report(df, seen).collect()}
    assert np.mean([got[k] == bool(q) for k, q in held.items()]) >= 0.97


# ---- op8


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = max(old[j + 1], row[j], old[j] + (x == y))
    return row[-1]


@pytest.mark.parametrize("whole", [True, False])
def test_alignment_is_longest(monkeypatch, whole):
    rng = random.Random(1)
    if not whole:  # every table is halved
        real = pages._rows
        monkeypatch.setattr(pages, "_rows", real)
        code = pages.shared_lines.__code__
        monkeypatch.setattr(pages.shared_lines, "__code__", code.replace(co_consts=tuple(4 if c == 1 << 26 else c for c in code.co_consts)))
    for _ in range(400):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 18))] for _ in range(2))
        at = sorted(pages.shared_lines(a, b))
        left = iter(b)
        assert len(at) == lcs(a, b) and all(a[k] in left for k in at)


@pytest.mark.parametrize("page,want", [
    ("<html><head><title>x</title><body><p>Hi", "Hi"), ("<ul><li class='ad'>A<li>B</ul><p>Real", "B\nReal"), ("<div><span class='ad'>x</div><p>Real", "Real"), ("<article><p class='search-for-gold'>gold", "gold"),
    ("<html><head>Stray<p>text", "Stray\ntext"), ("<form><div><article>In a form</article></div></form>", "In a form"), ("<section id=comments><article>c</article></section><article>A<article class=comment>c</article></article>", "A"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"), ("<header>top</header><main><header><h1>T</h1></header><p>x</main>", "T\nx"), ("<div role=navigation>n</div><p>a <i>b</i>&amp;c", "a b&c"), ("<p>a<div hidden>h</div>b", "a\nb"), ("<b>" * 3000 + "deep", "deep"),
])
def test_trees(page, want):
    found = pages.lines_of(page)
    assert pages.main_text("".join(f for f, _ in found), [x for _, x in found]) == want


def brute_pages(rows):
    """Every page against its host's pages in order, with no ranges or windows."""
    parsed = {k: pages.lines_of(h or "") for k, (_, _, h) in enumerate(rows)}
    out = {}

    def cut(url):
        head, _, rest = (url or "").partition("://")
        host, _, tail = rest.partition("/") if rest else ("", "", "")
        return host.lower(), ("/" + tail).split("?")[0].split("#")[0] if tail or rest.endswith("/") else ""

    order = sorted(range(len(rows)), key=lambda k: (*cut(rows[k][1]), f"{rows[k][0]:020d}", rows[k][1] or ""))
    for k in range(len(rows)):
        host, path = cut(rows[k][1])
        same = [j for j in order if cut(rows[j][1])[0] == host and parsed[j]]
        if not parsed[k]:
            out[rows[k][0]] = ""
            continue
        able = []
        for side in (same[: same.index(k)][::-1], same[same.index(k) + 1 :]):
            last, found = None, []
            for j in side:
                if parsed[j] != parsed[k] and parsed[j] != last:
                    found.append(j)
                last = parsed[j]
            able += found[:3]
        length = lambda j: len(os.path.commonprefix([cut(rows[j][1])[1], path]))
        best = sorted(able, key=lambda j: -length(j))[:3]
        lines = [t for _, t in parsed[k]]
        count = [0] * len(lines)
        for j in best:
            for at in pages.shared_lines(lines, [t for _, t in parsed[j]]):
                count[at] += 1
        frame = {at for at, n in enumerate(count) if 2 * n > len(best)} if best else set()
        out[rows[k][0]] = pages.main_text("".join(f for f, _ in parsed[k]), lines, frame)
    return out


@pytest.mark.parametrize("parts", ["3", "23"])
def test_pairing_by_brute_force(spark, parts):
    """Hosts over many ranges, runs of copies longer than ranges, pages without lines: as every page against its host."""
    rng = random.Random(7)
    rows = []
    for k in range(150):
        host = ["hot.org", "hot.org", "small.org", f"own{k % 9}.org"][k % 4]
        own = "copy of one text" if k % 5 < 2 and host == "hot.org" else f"text {rng.randint(0, 60)}"
        html = "" if k % 17 == 0 else f"<div>Site of {host}</div><div>Menu {'a' if k % 3 else 'b'}</div><p>{own}</p><p>quote {k % 4}</p><div>All rights</div>"
        rows.append((k, f"http://{host}/{'news' if k % 2 else 'blog'}/{k:03d}?q={k}", html))
    n = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    assert got == brute_pages(rows)


def test_differences_alone_find_the_frame(spark):
    """No element or attribute tells frame from text; short articles in large templates, with copies between."""
    frame = "".join(f"<div>Frame {k}</div>" for k in range(40))
    page = lambda k: f"<div>Top</div>{frame}" + "".join(f"<p>Text {k} part {j}</p>" for j in range(5)) + "<div>End</div>"
    rows = [(k, f"http://h/{k:02d}", page(k if k % 4 else 0), "x", k) for k in range(24)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, part int")
    got = {r.page_id: r for r in pages.extract(df).collect()}
    for k in range(24):
        assert got[k].text == "\n".join(f"Text {k if k % 4 else 0} part {j}" for j in range(5)) and got[k].n_frame == 42
    odd = [(None, None, None), (1, "http://h/1", "<p>a"), (1, "http://h/1", "<p>a"), (None, "x", "<p>b"), (2, "http://h/2", "")]
    assert sorted(r.text for r in pages.extract(spark.createDataFrame(odd, "page_id long, url string, html string")).collect()) == ["", "", "a", "a", "b"]


# ---- op10 and the pipeline's near copies


def test_near_copies_with_odd_rows(spark):
    base = prose(5, 400)
    copy = base.replace(base.split()[7], "other")
    rows = [(4, base, 1, "i", "f", "s"), (9, copy, 2, "i", "f", "s"), (None, base, 3, "i", "f", "s"), (7, base, 4, "i", "f", "s"), (7, prose(6, 30), 5, "i", "f", "s"), (8, None, 6, "i", "f", "s"), (10, "", 7, "i", "f", "s"), (11, prose(8, 30_000), 8, "i", "f", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep int, id string, fp string, search string")
    got = mih.keep_one(df).collect()
    assert sorted(r.rep for r in got) == [1, 3, 4, 5, 6, 8] and all(r[3:] == ("i", "f", "s") for r in got)
    again = mih.near_dedup(docs(spark, ["a b c d", "a b c d", "x y z"], ids=[3, 3, 3])).collect()
    assert sorted(r.component_id for r in again) == [3, 3, 3]


def test_hot_family_in_cells(spark):
    """A family far above a block whose links are chains: the classes are those of all pairs."""
    rng = np.random.default_rng(2)
    words = prose(12, 120).split()
    texts = []
    for k in range(420):
        w = list(words)
        for at in rng.choice(120, int(rng.integers(1, 5)), replace=False):
            w[at] = f"own{k}x{at}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for t in texts]
    near = [(a, b) for b in range(420) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = union(420, near)
    kept = sorted(r.doc_id for r in mih.keep_one(docs(spark, texts)).collect())
    assert len(near) > 300 and kept == [k for k in range(420) if want[k] == k]


def test_stages_keep_odd_rows(spark):
    import corpus_pipeline

    df = docs(spark, ODD, ids=[None, 1, 2, 3, 3, 5, 6, 7, 8, 9, 10, 11])
    labels_dir = SF if os.path.isdir(SF) else None
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, df, labels_dir or "")
        assert out.columns == df.columns and out.count() >= 8, name
        assert stage(spark, df.limit(0), labels_dir or "").count() == 0, name


# ---- op1: windows over the whole sorted table


def windowed_links(x, ties, leading, passes, window=64):
    """Links by walking each pass's whole sorted list, and runs of equal leading symbols, plainly."""
    keys = embeddings.sort_keys(embeddings._unit(list(x)), passes)
    u = embeddings._unit(list(x))
    near = u @ u.T >= 0.95
    found = set()
    for p in range(passes):
        head = keys[:, p] >> embeddings._BITS * (embeddings._SYMBOLS - leading)
        runs = {}
        for k, h in enumerate(head.tolist()):
            runs.setdefault(h, []).append(k)
        for run in runs.values():
            found |= {(a, b) for i, a in enumerate(run) for b in run[i + 1 :] if near[a, b]}
        order = sorted((k for run in runs.values() if len(run) <= window for k in run), key=lambda k: (keys[k, p], ties[k]))
        found |= {(min(a, b), max(a, b)) for i, a in enumerate(order) for b in order[max(0, i - window) : i] if near[a, b]}
    return found


def test_windows_do_not_depend_on_partitions(spark, monkeypatch):
    """Few passes, so that not every pair is found: those found are a plain walk's, with 4 and with 64 partitions and blocks of two sizes."""
    x = planted(1500, 1500, dim=16)
    x = np.concatenate([x, x[:1] + 0.001 * np.random.default_rng(1).standard_normal((150, 16))])
    df = vectors(spark, x)
    ties = [r[0] for r in df.orderBy("vec_id").selectExpr("xxhash64(embedding)").collect()]
    want = np.zeros(len(x), dtype=int)
    for a, b in windowed_links(x, ties, 4, 4):
        want[a] += 1
        want[b] += 1
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, block in ((4, 2048), (64, 2048), (4, 100)):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            monkeypatch.setattr(embeddings, "BLOCK", block)
            got = {r.vec_id: r.n_links for r in embeddings.near_dedup(df, leading=4, passes=4).collect()}
            assert [got[k] for k in range(len(x))] == want.tolist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert 0 < want[:1500].sum() and embeddings.near_dedup(df).agg({"n_links": "sum"}).first()[0] >= want.sum()
