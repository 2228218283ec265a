"""The training-data operators against brute force, and their edge cases, on small tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontaminate, jaccard, maincontent, mixing, pii, quality, suffixdedup, tokenbin, topk, warc
from quillon.llm.common import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None, sources=None, tmp=None):
    rows = [(ids[i] if ids else i, t, "en", sources[i] if sources else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if tmp is None:
        return df
    df.coalesce(1).write.parquet(str(tmp))
    return spark.read.parquet(str(tmp))


def prose(rng, n, words=("alpha", "beta", "Gamma", "delta,", "eps.", "über", "zeta", "eta", "theta", "iota")):
    return " ".join(rng.choice(words) for _ in range(n))


# --- WARC --------------------------------------------------------------------


def test_warc_roundtrip(spark, tmp_path):
    big = "é" * 600 + "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"
    rows = [(1, "u1", big), (2, "u\r\n2", big), (3, None, "x" * 999), (4, "u4", "x" * 999), (5, "u5", None), (6, "u6", ""), (7, "u7", big), (7, "u7", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), records_per_file=3)
    whole = warc.assemble(warc.read_archives(spark, str(tmp_path / "w"))).collect()
    assert len(whole) == 8
    for r in whole:
        page = r.metadata[0].page_id
        html = next(h or "" for p, _, h in rows if p == page).encode()
        assert r.response.payload_bytes == len(html) and r.response.payload_digest == hashlib.sha1(html).hexdigest()
        assert len(r.requests) == len(r.metadata) == 1 and r.requests[0].payload.startswith(b"GET ")
        assert r.response.payload == (b"" if r.record_type == "revisit" else html)
    kinds = Counter((r.metadata[0].page_id, r.record_type, r.refers_to_page) for r in whole)
    assert kinds == Counter([(1, "revisit", 7), (2, "revisit", 7), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (7, "revisit", 7)])


def test_warc_empty(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.assemble(warc.read_archives(spark, str(tmp_path / "w"))).count() == 0


# --- quality -----------------------------------------------------------------


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs).join(labels, "doc_id").select("q_keep", "quality").collect()
    right = sum(r.q_keep == (r.quality == 1) for r in got) / len(got)
    lost = [r for r in got if r.quality == 1 and not r.q_keep]
    assert right > 0.98 and len(lost) <= 0.005 * len(got), (right, lost)


def test_quality_edges(spark):
    docs = documents(spark, [None, "", " \n", "One good sentence here.", "One good sentence here.", "é"], ids=[1, 2, 3, 4, 4, None])
    got = {(r.doc_id, r.text): (r.q_score, r.q_keep) for r in quality.classify(docs).collect()}
    assert got[1, None] == got[2, ""] == got[3, " \n"] == (0.0, False)
    assert quality.classify(docs.where("doc_id > 99")).count() == 0
    clash = docs.withColumn("q_keep", F.lit(7)).withColumn("pattern", F.lit("x"))
    assert quality.kept(clash).columns == clash.columns


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.5
    accuracy = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.9, 0.8, 0.65])
    vote = np.where(rng.random((20000, 9)) < accuracy, truth[:, None], ~truth[:, None]) * 2 - 1
    vote[rng.random(vote.shape) < 0.3] = 0
    patterns, counts = np.unique([quality.pattern(tuple(v)) for v in vote], return_counts=True)
    _, found, share = quality.expectation_maximisation(patterns, counts.astype(float))
    assert np.abs(found - accuracy).max() < 0.03 and abs(share - 0.5) < 0.03


# --- Jaccard join ------------------------------------------------------------


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def brute_components(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets}


def near_copies(rng, n, size, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("hot", [2, 16])
def test_jaccard_brute_force(spark, hot):
    rng = random.Random(5)
    texts = near_copies(rng, 60, 100, 9) + near_copies(rng, 30, 12, 2) + near_copies(rng, 30, 400, 40) + [prose(rng, rng.randrange(12)) for _ in range(80)]
    texts += ["", None, " ", "one", "One", "one two", "the the the the the the", "THE THE THE THE THE", texts[0], texts[0].upper()]
    texts += [f"{texts[0]} extra{i}" for i in range(20)]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    df = documents(spark, [t for _, t in docs], [d for d, _ in docs])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, hot=hot).collect()}
    assert got == brute_components(docs)


def test_jaccard_edges(spark):
    df = documents(spark, ["a b c d e f", "a b c d e f", "x", None, "a b c d e f"], ids=[3, 3, 5, 6, None])
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.jaccard_components(df).collect())
    assert got == [("3", 2, "3"), ("3", 2, "3"), ("5", 1, "5"), ("6", 0, "6"), ("None", 2, "3")]
    assert jaccard.jaccard_components(df.where("doc_id > 9")).count() == 0
    assert sorted(str(r.doc_id) for r in jaccard.one_of_each(df.withColumn("component_id", F.lit("mine"))).collect()) == ["3", "5", "6", "None"]


def test_sketch_bounds():
    rng = np.random.default_rng(2)
    for n in (3, 50, 700):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 5], rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)]))
        x, y = (np.frombuffer(jaccard.bit_sketch(s), np.uint64)[None] for s in (a, b))
        w = min(x.shape[1], y.shape[1])
        assert np.bitwise_count(jaccard.fold(x, w) ^ jaccard.fold(y, w)).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60) if i % 9] + [(rng.randrange(100, 140), rng.randrange(100, 140)) for _ in range(25)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    want = {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


# --- long repeats ------------------------------------------------------------


def brute_repeats(texts, length, least=256):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[s : s + length] for t in raw for s in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = [False] * len(t)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        runs = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    if length == least:
        return [x[1] for x in out]
    return Counter((*x, n) for x, n in zip(out, brute_repeats(texts, least), strict=True))


@pytest.mark.parametrize(("strings", "hot"), [(400_000, 2000), (300, 2)])
def test_repeats_brute_force(spark, tmp_path, monkeypatch, strings, hot):
    monkeypatch.setattr(suffixdedup, "STRINGS", strings)
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    rng = random.Random(7)
    passages = [prose(rng, 90) for _ in range(4)]
    texts = [prose(rng, rng.randrange(200)) for _ in range(12)]
    texts += [f"{prose(rng, 30)} {p[rng.randrange(60):len(p) - rng.randrange(60)]} {prose(rng, 20)}" for p in passages for _ in range(4)]
    texts += ["ab" * 600, "a" * 900, "Zu " * 300, texts[0] * 3, texts[3], None, "", "ü" * 250, passages[0][:399], passages[0][:400]]
    df = documents(spark, texts, tmp=tmp_path / "d")
    got = Counter((r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256, r.n_repeated) for r in suffixdedup.remove_repeats(df).collect())
    assert got == brute_repeats(texts, 400)


def test_merge_equals_sorting():
    rng = np.random.default_rng(4)
    symbols = rng.integers(1, 4, (60, 4)).astype(np.int32)
    a, _ = suffixdedup.merge(suffixdedup.transform(symbols[:15], 0), suffixdedup.transform(symbols[15:25], 15), 4)
    whole, common = suffixdedup.merge(a, suffixdedup.transform(symbols[25:], 25), 4)
    suffixes = [tuple(symbols[s][k:]) for s, k in zip(whole.string, whole.at, strict=True)]
    assert [x[:4] for x in suffixes] == sorted(x[:4] for x in suffixes)
    assert [symbols[s][k - 1] if k else 0 for s, k in zip(whole.string, whole.at, strict=True)] == whole.symbols.tolist()
    for i in range(1, len(suffixes)):
        x, y = suffixes[i - 1], suffixes[i]
        same = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert common[i] == same


def test_repeats_empty(spark, tmp_path):
    assert suffixdedup.remove_repeats(documents(spark, ["x"], tmp=tmp_path / "d").where("doc_id > 5")).count() == 0


# --- token ids ---------------------------------------------------------------


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (1, 9), (3000, 7), (3000, 10**8)):
        v = np.sort(rng.integers(0, top, n))
        code = tokenbin.EliasFano.encode(v)
        assert (code.all() == v).all() and all(code.select(i) == x for i, x in enumerate(v.tolist()))
        if n == 3000 and top > 10**6:
            assert 8 * (len(code.low) + len(code.high)) / n < 3 + np.log2(top / n)


def test_tokens_equal_whole_texts():
    coder = tokenbin.ChunkTokenizer(tokenbin.tokenizer_path())
    rng = random.Random(3)
    atoms = ["a", "B", "é", "H̱", "İ", "'s", "it's!!", "<|endoftext|>", "<|STARTOFTEXT|>", "...", "!", "%%%", " ", "\n", " ", "　", "1", "２", "…", "foo…!!", "ß", "K", "don't.", "x|", "\x00", "\x1c", "word,", "😀"]
    for _ in range(600):
        texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(12))) for _ in range(3)]
        for text, got in zip(texts, coder.encode([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(got, coder.dtype).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_distinct_pieces_are_looked_up_once():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    coder = tokenbin.ChunkTokenizer(tokenbin.tokenizer_path())
    coder.known, coder.before = Counted(), Counted()
    texts = ["!! One two, " * 5000, None, "", " \n", "two <|endoftext|> Two," * 50, "...", "one"]
    got = coder.encode([None if t is None else t.encode() for t in texts])
    assert Counted.asked < 30
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, coder.dtype).tolist() == coder.tokenizer.encode(text or "", add_special_tokens=False).ids
    assert coder.encode([]) == [] and coder.encode([None, b" "]) == [b"", b""]


def test_token_files(spark, tmp_path):
    texts = ["Zwei words", None, "", "x " * 200_000, "again", "again"]
    ids = [5, 3, 4, 1, 2, 2]
    df = documents(spark, texts, ids)
    folder = f"file://{tmp_path}/ids"
    manifest = tokenbin.write_ids(df, folder, tokenbin.tokenizer_path(), file_ids=1000).collect()
    got = sorted(tokenbin.read_ids(spark, manifest, with_ids=True).collect(), key=lambda r: r.start)
    coder = tokenbin.ChunkTokenizer(tokenbin.tokenizer_path())
    at = 0
    for r, (d, t) in zip(got, sorted(zip(ids, (t or "" for t in texts), strict=True)), strict=True):
        want = [*np.frombuffer(coder.encode([t.encode()])[0], coder.dtype).tolist(), 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (d, at, len(want), want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    reader = tokenbin.Reader(manifest[0].uri)
    assert [reader.document(i).tolist() for i in range(len(reader.docs))] == [x.tolist() for _, _, x in reader.documents()]
    assert tokenbin.token_rows(df.where("doc_id > 9")).count() == 0


# --- mixing ------------------------------------------------------------------


def test_sainte_lague_is_highest_quotients():
    rng = random.Random(1)
    for _ in range(60):
        weights = [rng.choice([0, 1, 2, 3.5, rng.random() * 9]) for _ in range(rng.randrange(1, 7))]
        seats, most = rng.randrange(40), [rng.randrange(1, 30) for _ in weights]
        want = [0] * len(weights)
        for _ in range(seats):
            open_ = [(-w / (2 * q + 1), i) for i, (w, q) in enumerate(zip(weights, want, strict=True)) if w > 0 and q < most[i]]
            if open_:
                want[min(open_)[1]] += 1
        assert mixing.sainte_lague(weights, seats, most) == want


def test_targets():
    assert mixing.targets([10, 10], [1, 2]) == pytest.approx([20 / 3, 40 / 3])
    assert mixing.targets([100, 1, 1], [1, 2, 3]) == pytest.approx([96, 3, 3])
    assert mixing.targets([0, 0], [1, 2]) == [0, 0] and mixing.targets([], []) == []


def test_mix(spark):
    rng = random.Random(2)
    sources = [rng.choice(["a", "a", "a", "a", "b", "B", "é", None]) for _ in range(400)]
    texts = [prose(rng, rng.randrange(300)) for _ in sources] + [None, ""]
    df = documents(spark, texts, ids=[*range(400), 7, 7], sources=[*sources, "a", "b"])
    rows = mixing.mix(df).collect()
    per = defaultdict(lambda: [0, 0, 0.0, 0])
    for r in rows:
        assert r.q_size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.q_taken <= 3 * r.q_size
        s = per[r.source]
        s[0] += r.q_size
        s[1], s[2] = r.q_source_size, r.q_target
        s[3] += r.q_taken
    names = sorted(per, key=lambda s: (s is None, s or ""))
    want = mixing.targets([per[s][0] for s in names], [float(mixing.WEIGHTS[i % 3]) for i in range(len(names))])
    for s, t in zip(names, want, strict=True):
        assert per[s][0] == per[s][1] and per[s][2] == pytest.approx(t) and abs(per[s][3] - t) <= 0.03 * t + 128
    words = defaultdict(int)
    for r in rows:
        assert (r.q_copies > 0) <= (r.q_taken > 0)
        words[r.source] += r.q_copies * r.q_size
    assert all(abs(words[s] - t) <= 0.25 * t + 600 for s, t in zip(names, want, strict=True))
    again = mixing.mix(df.repartition(3)).collect()
    assert Counter((r.doc_id, r.text, r.q_taken) for r in again) == Counter((r.doc_id, r.text, r.q_taken) for r in rows)
    assert mixing.mix(df.where("doc_id > 900")).count() == 0
    assert mixing.mixed_documents(df.withColumn("q_size", F.lit(1))).columns == [*df.columns, "q_size"]


# --- main text ---------------------------------------------------------------


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=x>Menu</a></nav><p>", ""),
        ("<html><body><header><h1>Site</h1></header><nav><ul><li><a>A</a><li><a>B</a></ul></nav><article><header><h1>T &amp; U</h1></header><p>One <b>bold\n\n text<br>next<p>Two &copy; 5 &lt; 6</article><aside>Side</aside><footer>Foot</footer>", "T & U\n\nOne bold text next\n\nTwo © 5 < 6"),
        ('<main><p>Body text of the page stands here.</p><div class="comments"><article><p>I disagree.</p></article></div><form><p>Mail</p><input></form></main><div id="cookie-notice"><p>We use cookies</p></div>', "Body text of the page stands here."),
        ('<body><div class="sidebar"><p>Other</p></div><div class="content"><h2>Head</h2><p>The first paragraph says quite a lot, really.</p><script>if (a<b) "</p>"</script><p>So does the second.</p></div></body>', "Head\n\nThe first paragraph says quite a lot, really.\n\nSo does the second."),
        ('<div class="content-with-sidebar"><article><div class="article-header"><h1>Head</h1></div><p>Text of some length.</p><div class="share-bar"><p>Share this</p></div></article><div class="sidebar"><p>Other things</p></div></div>', "Head\n\nText of some length."),
        ("<article><p>a < b and c</p><!-- no --><p>&nbsp;x&#x41;&nbsp;</p></article>", "a < b and c\n\nxA"),
    ],
)
def test_main_text(page, text):
    assert maincontent.main_text(page) == text


def test_main_text_whole_table(spark):
    import html

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", article)]
        assert maincontent.main_text(r.html) == "\n\n".join(x for x in parts if x)


def article_of(page):
    import html

    article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", article)]
    return "\n\n".join(x for x in parts if x)


def test_main_text_without_names(spark):
    """The classifier carries over to pages that name none of their parts, and the cut does the rest."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    table = spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "page_id long, html string")
    weights = maincontent.fitted(table)
    assert weights != tuple(maincontent.PRIOR.values())
    strip = lambda h: re.sub(r'\s(class|id|role)="[^"]*"', "", re.sub(r"<(/?)(article|main|nav|footer|header|aside)\b", r"<\1div", h))
    same = [maincontent.main_text(strip(h), weights) == article_of(h) for h in pages]
    assert sum(same) >= 0.98 * len(same)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # a linked word amid paragraphs is content, a plain sentence amid linked ones is not
        ("<div><h2>On rivers</h2><p>{0}</p><p><a href=x>More</a></p><p>{0}</p></div>", "On rivers\n\n{0}\n\nMore\n\n{0}"),
        ("<div><p>{0}</p><p>{0}</p><p>{0}</p></div><div><p><a>One</a></p><p><a>Two</a></p><p>Three is a plain sentence here.</p><p><a>Four</a></p><p><a>Five</a></p></div>", "{0}\n\n{0}\n\n{0}"),
    ],
)
def test_cut_against_sign(page, text):
    river = "The river rises in the hills and runs for many miles before it comes to the sea, past towns and mills."
    found = maincontent.blocks(page.format(river))
    labels = maincontent.content(found)
    signs = [maincontent.score(f, tuple(maincontent.PRIOR.values())) > 0 for f in maincontent.features(found)]
    assert sum(a != b for a, b in zip(labels, signs, strict=True)) == 1
    assert maincontent.main_text(page.format(river)) == text.format(river)


def test_extract_edges(spark):
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (2, "u", "<article><p>Text of the page.</p></article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, q_text string")
    out = maincontent.extract(df)
    assert out.columns == ["page_id", "url", "html", "q_text"] and sorted(r.q_text for r in out.collect()) == ["", "", "Text of the page."]
    assert maincontent.extract(df.where("page_id > 5")).count() == 0


def test_min_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randrange(1, 8)
        source, sink = [rng.random() for _ in range(n)], [rng.random() for _ in range(n)]
        ties = {(i, j): rng.random() * 0.6 for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5}

        def cost(labels, source=source, sink=sink, ties=ties):
            return sum(t if keep else s for keep, s, t in zip(labels, source, sink, strict=True)) + sum(c for (i, j), c in ties.items() if labels[i] != labels[j])

        assert cost(maincontent.min_cut(source, sink, ties)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))


def test_main_text_long_page():
    page = "<article>" + "".join(f"<p>Sentence number {i} of a very long page.</p>" for i in range(20_000)) + "</article>"
    assert maincontent.main_text(page).count("\n\n") == 19_999


# --- personal data -----------------------------------------------------------


def luhn(x):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(x))) % 10 == 0


def base_spans(text):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans(spark, tmp_path):
    rng = random.Random(8)
    atoms = ["a", "B", ".", "@", "-", " ", "1", "4242424242424242", "+1", "(555)", "300.1.2.3", "10.0.0.1", "😀", "é", "", "", "", "x@y.z", "_", "%", "0000255.1.1.1", "4242 4242-4242 4242", "+49 (0) 30-123456", "\n"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(25))) for _ in range(600)]
    texts += ["1 " * 20_000, "a.b@" + "c." * 20_000 + "d", "9" * 50_000, "+1" * 5000, "@" * 3000, None, ""]
    df = documents(spark, texts, tmp=tmp_path / "d")
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans if s.base] for r in pii.find_personal_data(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [(a, b, k) for a, _, b, k in base_spans(t or "")], t[:200]


def test_bootstrapping_finds_unseen(spark, tmp_path):
    seen = [f"Please call Zmobile: +1 555 010 {i:04d} today" for i in range(8)]
    unseen = ["Reach Zmobile: 555-010-9999 now", "Zmobile: (555) 010-7777"]
    clean = ["the year 2024-2025-2026 was long", "order 1234567 came", "the 7654321 of the +1 555 010 1234 the", "nothing at all"]
    df = documents(spark, [*seen, *unseen, *clean], tmp=tmp_path / "d")
    added = {r.doc_id: [df_text(s, r.doc_id, [*seen, *unseen, *clean]) for s in r.spans if not s.base] for r in pii.find_personal_data(df).collect()}
    assert added[8] == ["555-010-9999"] and added[9] == ["555) 010-7777"]
    assert all(not x for i, x in added.items() if i not in (8, 9))


def df_text(span, i, texts):
    return texts[i][span.start : span.end]


def test_personal_data_empty(spark, tmp_path):
    df = documents(spark, ["x"], tmp=tmp_path / "d").where("doc_id > 3")
    assert pii.find_personal_data(df).count() == 0


# --- top-k -------------------------------------------------------------------


def test_topk_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), rng.normal(size=8).astype("f4").tolist()) for i in range(700)]
    rows += [(1000, [0.0] * 8), (1001, None), (1002, [None] * 8), (1003, [float("nan")] * 8), (1004, [float("inf")] + [0.0] * 7), (1100, rows[5][1]), (1101, rows[5][1]), (1200, [1.0, 2.0]), (None, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    ints = topk.usable(df, "vec_id", "embedding", 1024)
    got = defaultdict(list)
    for r in topk.top_k(ints, ints.where("id % 100 = 0"), 10, block_queries=3, block_rows=100).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = {i: [int(np.floor(1024 * float(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in good if i % 100 == 0):
        want = sorted(((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:10]
        assert got[q] == [(i, -s) for s, i in want]


def test_threshold_stops_early():
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(5000, 2)) * 1000).astype(np.int64)
    lists = topk.SortedLists(np.arange(5000), v)
    scored = []
    score = lists.scores
    lists.scores = lambda rows, q: scored.append(len(rows)) or score(rows, q)
    lists.top(-1, np.array([700, -300]), 10)
    assert sum(scored) < 2500


def test_topk_large_values():
    v = np.array([[1 << 30, 1], [(1 << 30) + 1, 0]], np.int64)
    ids, scores = topk.SortedLists(np.array([0, 1]), v).top(-1, np.array([1 << 29, 1]), 2)
    assert scores.tolist() == [((1 << 30) + 1) << 29, (1 << 59) + 1] and ids.tolist() == [1, 0]


# --- decontamination ---------------------------------------------------------


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(texts, items, window=8):
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[k : k + n])].add(i)
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if (x := wins.get(tuple(w[k : k + n]))) is not None:
                    found |= x
                    hit |= set(range(k, k + n))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_decontamination_brute_force(spark, block_bytes):
    rng = random.Random(11)
    items = [(i, prose(rng, rng.randrange(4, 30))) for i in range(12)] + [(50, "rare pair"), (51, None), (52, ""), (53, "!!"), (2, "single"), (60, "ÜBER näher")]
    texts = [prose(rng, rng.randrange(60)) for _ in range(60)] + [f"{prose(rng, 5)} {t} {prose(rng, 5)}" for _, t in items if t]
    texts += [None, "", "a RARE-pair, single", "über näher", "rare", texts[0], texts[0]]
    docs = documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.judge(docs, bench, block_bytes=block_bytes).orderBy("doc_id").collect()
    assert [(r.q_n_words, r.q_n_hit, r.q_n_items, r.q_items_sha256) for r in got] == brute_hits(texts, items)


def test_longest_matches(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = documents(spark, [f"x {' '.join(f'w{i}' for i in range(3, 18))} y", "none of it"])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_start, r.doc_start, r.n_match) for r in decontaminate.matches(docs, bench).collect()] == [(0, 3, 1, 15)]


def test_decontamination_keeps_clean(spark):
    docs = documents(spark, ["a b c d e f g h i", "clean text stays here"]).withColumn("q_n_items", F.lit("mine"))
    bench = spark.createDataFrame([(1, "b c d e f g h i")], "item_id long, text string")
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [1]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).count() == 2
    assert decontaminate.judge(docs.where("doc_id > 5"), bench).count() == 0


# --- the pipeline ------------------------------------------------------------


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from quillon.llm.common import table

    docs = table(spark, SF, "documents").cache()
    rows = docs.collect()
    names = docs.columns

    kept = corpus_pipeline.quality_classifier(spark, docs, SF)
    assert kept.columns == names and 0 < kept.count() < len(rows)

    once = corpus_pipeline.jaccard_join(spark, docs, SF)
    want = {d for d, (_, c) in brute_components([(r.doc_id, r.text) for r in rows]).items() if d == c}
    assert once.columns == names and {r.doc_id for r in once.collect()} == want

    clean = corpus_pipeline.benchmark_decontamination(spark, docs, SF)
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    want = {r.doc_id for r, h in zip(rows, brute_hits([r.text for r in rows], items), strict=True) if h[2] == 0}
    assert clean.columns == names and {r.doc_id for r in clean.collect()} == want

    mixed = corpus_pipeline.source_mixing(spark, docs, SF)
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == names and max(times.values()) <= 3
    assert all(times[r.doc_id] == r.q_copies for r in mixing.mix(docs).collect())

    got = corpus_pipeline.token_id_output(spark, docs, SF).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in rows)
    assert all(b.start == a.start + a.n_tokens for a, b in itertools.pairwise(got))


def test_pipeline_runs(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert corpus_pipeline.run(spark, SF).count() > 0


# --- row names and splits ----------------------------------------------------


@pytest.mark.parametrize("name", ["op1", "op3", "op4", "op6", "op8", "op10"])
def test_results_hold_when_splits_change(spark, tmp_path, monkeypatch, name):
    """Every written table changes how the next scan is split, as lost and late executors do."""
    from quillon.llm import common

    for table in ("documents", "pages", "benchmark"):
        df = spark.read.parquet(f"{SF}/{table}.parquet")
        (df.repartition(9) if table != "benchmark" else df).write.parquet(str(tmp_path / f"{table}.parquet"))
    if name == "op10":  # several blocks of test items
        run = lambda: decontaminate.judge(common.table(spark, tmp_path, "documents"), common.table(spark, tmp_path, "benchmark"), block_bytes=600)
    else:
        query = {"op1": warc.op1, "op3": jaccard.op3, "op4": suffixdedup.op4, "op6": mixing.op6, "op8": pii.op8}[name]
        run = lambda: query(spark, str(tmp_path))
    want = Counter(map(tuple, run().collect()))
    plain, turn = common.stored, itertools.cycle([("1", "0"), ("40", "64k"), ("3", "4m")])

    def shaken(*args):
        cores, cost = next(turn)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        return plain(*args)

    for module in (common, jaccard):
        monkeypatch.setattr(module, "stored", shaken)
    try:
        assert Counter(map(tuple, run().collect())) == want
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_row_names_of_other_plans(spark):
    from quillon.llm.common import placed

    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").toDF("_metadata")
    for plan in (df, df.union(df), df.select(F.explode(F.array("_metadata", "_metadata"))), df.groupBy("_metadata").count(), df.where("_metadata > 10")):
        rows = placed(plan).select("q_file", "q_row").collect()
        assert len(set(rows)) == len(rows) == plan.count()


def test_labels_glued_to_identifiers(spark, tmp_path):
    seeds = [f"word badge:+1 555 010 {1000 + i} more text" for i in range(6)]
    unseen = ["word badge:77-1234567 more", "word badge: 88-7654321 more"]
    clean = ["order 99-1112223 of screws", "the screws (55-4443332) came"]
    df = documents(spark, [*seeds, *unseen, *clean], tmp=tmp_path / "d")
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if not s.base] for r in pii.find_personal_data(df).collect()}
    assert found[6] == [("phone", 11, 21)] and found[7] == [("phone", 12, 22)]
    assert not any(found[k] for k in (*range(6), 8, 9))


def test_contexts_of_any_length(spark, tmp_path):
    long = "x" * 300
    df = documents(spark, [*(f"{long} +1 555 010 {1000 + i} y" for i in range(5)), f"{long} 77-1234567 y"], tmp=tmp_path / "d")
    found = {r.doc_id: [(s.start, s.end) for s in r.spans if not s.base] for r in pii.find_personal_data(df).collect()}
    assert found[5] == [(301, 311)]


# --- long texts, empty tables, clashing names --------------------------------


def test_long_text(spark, tmp_path):
    rng = random.Random(12)
    long = prose(rng, 150_000, words=[f"w{i}" for i in range(5000)])
    texts = [long, f"{long} and one more", "short text of a few words", None, ""]
    df = documents(spark, texts, tmp=tmp_path / "d")
    same = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()}
    assert same[0] == same[1] == 0 and same[2] == 2
    gone = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffixdedup.remove_repeats(df).collect()}
    assert gone[0] == (len(long), len(long)) and gone[1] == (len(long) + 13, len(long)) and gone[2][1] == 0
    taken = {r.doc_id: r.q_size for r in mixing.mix(df).collect()}
    assert taken == {0: 150_000, 1: 150_003, 2: 6, 3: 0, 4: 0}
    bench = spark.createDataFrame([(1, " ".join(long.split()[70_000:70_020]))], "item_id long, text string")
    hits = {r.doc_id: r.q_n_hit for r in decontaminate.judge(df, bench).collect()}
    assert hits == {0: 20, 1: 20, 2: 0, 3: 0, 4: 0}
    assert {r.doc_id for r in quality.classify(df).where("not q_keep").collect()} >= {3, 4}


def test_empty_tables(spark, tmp_path):
    none = documents(spark, ["x"], tmp=tmp_path / "d").where("doc_id > 5")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(topk.usable(vectors, "vec_id", "embedding", 1024), topk.usable(vectors, "vec_id", "embedding", 1024), 10).count() == 0
    assert jaccard.one_of_each(none).count() == quality.kept(none).count() == mixing.mixed_documents(none).count() == tokenbin.token_rows(none).count() == 0


def test_clashing_names(spark, tmp_path):
    df = documents(spark, ["some words of text here and there"] * 3, tmp=tmp_path / "d").toDF("doc_id", "text", "q_file", "k1", "rep")
    assert jaccard.one_of_each(df).columns == df.columns and jaccard.one_of_each(df).count() == 1
    twice = df.select("doc_id", "text", F.lit("a").alias("source"), F.lit(1).alias("q_taken"), F.lit(2).alias("q_row"))
    assert mixing.mixed_documents(twice).columns == twice.columns
    assert mixing.mix(twice).columns == ["doc_id", "text", "source", "q_row", *mixing.ADDED]
    assert quality.classify(df.withColumn("q_score", F.lit("x"))).columns == [*df.columns, "q_posterior", "q_score", "q_keep"]


def test_short_items_take_no_part(spark, tmp_path):
    df = documents(spark, ["the cat sat on the mat", " ".join(f"w{i}" for i in range(30))], tmp=tmp_path / "d")
    bench = spark.createDataFrame([(1, "the"), (2, " ".join(f"w{i}" for i in range(5, 20)))], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.decontaminate(df, bench).collect()] == [0]


def test_bounds_guard_one_sided_labellers():
    """With noisy voters that speak for one class only, EM without bounds calls junk good; bounds hold it back."""
    rng = np.random.default_rng(3)
    n = 20_000
    good = rng.random(n) < 0.8
    v = np.zeros((n, len(quality.LABELLERS)), int)
    for k in range(6):
        v[:, k] = -1 * ((~good & (rng.random(n) < 0.4)) | (good & (rng.random(n) < 0.01)))
    for k in (6, 7):
        v[:, k] = (good & (rng.random(n) < 0.8)) | (~good & (rng.random(n) < 0.05))
    v[:, 8] = rng.random(n) < 0.5
    patterns, inverse, counts = np.unique([quality.pattern(x) for x in v], return_inverse=True, return_counts=True)
    heard = (v != 0).any(1)

    def right(**how):
        posterior, _, _ = quality.expectation_maximisation(patterns, counts.astype(float), **how)
        return ((posterior[inverse] >= 0.5) == good)[heard].mean()

    assert right() > 0.88 and right() > right(bounds=(1e-4, 1 - 1e-4)) + 0.03
