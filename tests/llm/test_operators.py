"""Every operator of the training-data subpackage against plain Python on awkward small tables."""

import collections
import hashlib
import io
import itertools
import math
import random
import re
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import html_crf, mixing, packing, quality_cnn, quality_rules, simhash, suffix_dedup, topk_search, warc, window_dedup, windows
from folioscope.llm import registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, k long, f long, doc string, items string, copies int, quality_score string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["ta", "re", "in", "so", "mé", "ka", "ür"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, copies, near copies, repeated rows, shared passages, periodic text."""
    rng = random.Random(5)
    shared, line = prose(rng, 60), prose(rng, 12)
    texts = [prose(rng, rng.randint(1, 150)) for _ in range(40)]
    texts += [f"{prose(rng, 30)} {shared} {prose(rng, 25)}" for _ in range(6)]
    texts += [f"{prose(rng, 9)} {line} {prose(rng, 9)}" for _ in range(15)]
    texts += [texts[3], texts[3], texts[3] + " tail", texts[3].upper(), None, "", "  \n\t ", "one", "one two", "Shti " * 300, prose(rng, 4000), "<|endoftext|> a", "naïve ☃   text", "#$% | a | b &", "x\x00y"]
    out = [(i * 10, t, "en", f"s{i % 4}" if i % 11 else None, None, 1, 2, "d", "i", 3, "q") for i, t in enumerate(texts)]
    out += [out[2], out[2], (None, texts[5], None, None, 0, 0, 0, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def key(doc_id):
    return -1 if doc_id is None else doc_id


# ------------------------------------------------------------------ op1 and op7


def brute_words(rows, width):
    tokens = [(key(r[0]), WORD.findall(r[1] or "")) for r in rows]
    first = {}
    for d, w in sorted(tokens, key=lambda x: x[0]):
        for i in range(len(w) - width + 1):
            first[tuple(w[i : i + width])] = min(first.get(tuple(w[i : i + width]), (d, i)), (d, i))
    out = []
    for d, w in tokens:
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (d, i):
                gone.update(range(i, i + width))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("width", "gram", "hot"), [(20, 7, 8), (5, 2, 1)])
def test_word_windows(docs, rows, width, gram, hot, monkeypatch):
    monkeypatch.setattr(windows, "HOT_AT", hot)
    removed = window_dedup.removed_windows(docs, width, gram)
    got = window_dedup.remove_windows(docs, removed, width).collect()
    assert sorted((key(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(rows, width)
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in got)


def brute_bytes(rows, width):
    texts = [(key(r[0]), (r[1] or "").encode()) for r in rows]
    count = collections.Counter(t[i : i + width] for _, t in texts for i in range(len(t) - width + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                gone[i : i + width] = True
        left = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), int(gone.sum()), sum(1 for g, _ in itertools.groupby(gone) if g), hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("width", "gram", "hot"), [(200, 72, 8), (30, 9, 8), (30, 9, 1)])
def test_byte_windows(docs, rows, width, gram, hot, monkeypatch):
    monkeypatch.setattr(windows, "HOT_AT", hot)
    removed = suffix_dedup.removed_windows(docs, width, gram)
    got = suffix_dedup.remove_windows(docs, removed, width).collect()
    assert sorted((key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(rows, width)


def test_run_length_index_gives_longest_matches():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(12)] + [b"abab" * 20]
    index = suffix_dedup.RunLengthIndex(texts)
    found = index.matching_statistics()
    places = [(i, j) for i, t in enumerate(texts) for j in range(len(t))]
    for i, j in places:
        best = 0
        for a, b in places:
            if (a, b) != (i, j):
                n = 0
                while j + n < len(texts[i]) and b + n < len(texts[a]) and texts[i][j + n] == texts[a][b + n]:
                    n += 1
                best = max(best, n)
        assert found[index.starts[i] + j] == best
    assert index.run_lengths.sum() == len(index.letters)


def test_cut_documents_keeps_columns(docs):
    got = suffix_dedup.cut_documents(docs)
    assert got.columns == docs.columns
    assert got.count() == docs.count()


# ------------------------------------------------------------------ op2


def test_classifier_learns_and_scores(spark):
    rng = random.Random(3)
    texts, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        body = prose(rng, rng.randint(10, 80))
        texts.append(body if good else " ".join(w + "%%%" for w in body.split()))
        labels.append(int(good))
    p = quality_cnn.train([t.encode() for t in texts[:160]], labels[:160], epochs=8)
    scores = quality_cnn.score_rows(p, pa.array(texts[160:]))
    assert np.mean((scores >= 0.5) == np.array(labels[160:])) > 0.95
    again = quality_cnn.train([t.encode() for t in texts[:160]], labels[:160], epochs=8)
    assert all((p[k] == again[k]).all() for k in p)


def test_classifier_gradients():
    p = {k: v.astype(np.float64) for k, v in quality_cnn.init_params(1).items()}
    data = np.frombuffer(b"some text %% of a document" * 12 + b"other", np.uint8)
    parts = quality_cnn.blocks_of(data, np.array([0, 290, 290, len(data)]))
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])

    def loss():
        logit = quality_cnn.forward(p, *parts)
        return float(((np.logaddexp(0, logit) - y * logit) * weight / weight.sum()).sum())

    grad = quality_cnn._gradients(p, *parts, y, weight)
    rng = np.random.default_rng(0)
    for name in ("left", "right", "bias", "chunk", "out", "out_bias", "embed"):
        flat, g = p[name].reshape(-1), grad[name].reshape(-1)
        for i in rng.choice(len(flat), min(4, len(flat)), replace=False):
            old, step = flat[i], 1e-5
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert (up - down) / (2 * step) == pytest.approx(g[i], abs=2e-4)


def test_classifier_query_on_awkward_rows(spark, docs, tmp_path):
    params = quality_cnn.init_params()
    got = quality_cnn.score(docs.select("doc_id", "text", "quality_score"), params).collect()
    assert len(got) == docs.count() and all(0 <= r.quality_score <= 1 for r in got)
    alone = {r.text: r.quality_score for r in got}
    for text, value in alone.items():
        assert quality_cnn.score_rows(params, pa.array([text], pa.string()))[0] == pytest.approx(value, abs=1e-5)
    labels = spark.createDataFrame([(10, 1, 0), (10, 0, 0), (None, 1, 0), (20, None, 0), (30, 0, 1)], "doc_id long, quality int, toxic int")
    texts, known = quality_cnn.training_sample(docs, labels)
    held = {i for i in (10, 20, 30) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert len(texts) == len({10, 30} - held) == len(known)
    assert quality_cnn.training_sample(docs, labels.limit(0)) == ([], [])


# ------------------------------------------------------------------ op3

PAGES = [(5, "http://a/ b\r\n", "<p>x</p>"), (2, None, "<p>x</p>"), (9, "u", "<p>x</p>"), (2, "again", "<p>x</p>"), (7, "v", None), (8, "w", ""), (None, "n", "<p>x</p>"), (11, "é", "ünique"), (12, "z", "y" * 200_000)]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    folder = f"file://{tmp_path}/archives"
    archives = warc.write_archives(warc.with_first(pages), folder, archive_bytes=300).persist()
    got = warc.read_archives(archives, folder).collect()
    assert len(got) == len(PAGES) and archives.count() > 3
    by_payload = collections.defaultdict(list)
    for i, _, html in PAGES:
        by_payload[html or ""].append(i)
    payloads = {warc.digest_of(h.encode()): h for h in by_payload}
    for r in got:
        html = payloads[r.payload_digest]
        least = min(i for i in by_payload[html] if i is not None)
        assert r.payload_bytes == len(html.encode())
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == least else ("revisit", least))
        assert r.payload == (html.encode() if r.record_type == "response" else None)
    assert sorted((key(r.page_id), r.url or "") for r in got) == sorted((key(i), u or "") for i, u, _ in PAGES)
    # an independent reader agrees on the container
    with zipfile.ZipFile(archives.first().path) as z:
        assert z.testzip() is None and set(z.namelist()) == {warc.DATA_MEMBER, warc.INDEX_MEMBER}


def test_zip_reader_reads_foreign_archives():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a.txt", b"alpha")
        z.writestr("b/ü.bin", b"beta" * 100)
        z.comment = b"a comment"
    reader = warc.ZipReader(raw, len(raw.getvalue()))
    at, n = reader.range_of("b/ü.bin")
    assert reader.read(at, n) == b"beta" * 100
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", b"alpha" * 50)
    with pytest.raises(ValueError, match="not stored"):
        warc.ZipReader(packed, len(packed.getvalue())).range_of("a.txt")
    with pytest.raises(ValueError):
        warc.ZipReader(io.BytesIO(b"nothing"), 7)
    assert struct.calcsize("<HHQQQ") == 28


# ------------------------------------------------------------------ op4


def brute_search(rows, k, terms, min_df):
    marks = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())

    def tokens(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return [w for w in (w.strip(marks) for w in WORD.findall(low)) if w]

    def hashed(term):
        return int(topk_search.term_counts(pa.array([term]))[1][0])

    counts = [(r[0], collections.Counter(tokens(r[1]))) for r in rows]
    n, mean = len(rows), max(1.0, sum(sum(c.values()) for _, c in counts) / len(rows))
    df = collections.Counter(t for _, c in counts for t in c)
    idf = {t: math.log(1 + (n - v + 0.5) / (v + 0.5)) for t, v in df.items()}
    distinct = list({(r[0], r[1]): c for r, (_, c) in zip(rows, counts)}.items())
    out = {}
    for q, c in counts:
        if q is None or q % 20:
            continue
        own = {t: round(idf[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)), 9) for t in c}
        asked = sorted((t for t in c if df[t] >= min_df), key=lambda t: (-own[t], hashed(t)))[:terms]
        found = []
        for (d, _), x in distinct:
            score = sum(idf[t] * x[t] * 2.2 / (x[t] + 1.2 * (0.25 + 0.75 * sum(x.values()) / mean)) for t in asked if x[t])
            if any(x[t] for t in asked):
                found.append((-round(score, 9), key(d)))
        out[q] = sorted(found)[:k]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("block", [64, 2])
def test_search_equals_full_scoring(docs, rows, block, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    queries = docs.filter("doc_id % 20 = 0")
    got = collections.defaultdict(list)
    for r in sorted(topk_search.search(docs, queries, k=5, terms=6).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((-round(r.score, 9), key(r.doc_id)))
    want = brute_search(rows, 5, 6, 2)
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in want.items()}


def test_op4_asks_with_all_terms(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.defaultdict(list)
    for r in topk_search.op4_bm25_wand(spark, str(tmp_path)).collect():
        got[r.query_id].append((-round(r.score, 6), key(r.doc_id)))
    want = brute_search(rows, 10, None, 1)
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted((round(s, 6), d) for s, d in v) for q, v in want.items()}


@pytest.mark.parametrize(("block", "dense"), [(64, 0.05), (4, 0.3), (8, 2.0)])
def test_block_max_pruning_equals_exhaustive_scoring(block, dense, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    monkeypatch.setattr(topk_search, "DENSE", dense)
    rng = np.random.default_rng(2)
    for trial in range(40):
        n = int(rng.integers(1, 400))
        at = [(d, t, round(float(rng.random()), 1) + 0.1) for t in range(12) for d in np.flatnonzero(rng.random(n) < rng.random())]
        if not at:
            continue
        doc, term, score = (np.array(x) for x in zip(*at, strict=True))
        shard = topk_search.Shard(doc, term * 7, score, rng.integers(1, 50, n))
        asks = [np.sort(rng.choice(15, int(rng.integers(0, 8)), replace=False)) * 7 for _ in range(9)]
        weights = [rng.random(len(a)) + 0.1 for a in asks]
        want = []
        for a, w in zip(asks, weights, strict=True):
            total = collections.Counter()
            for d, t, x in at:
                if t * 7 in a:
                    total[int(d)] += x * w[list(a).index(t * 7)]
            want.append(sorted(((-s, d) for d, s in total.items()))[:10])
        floors = np.array([-x[-1][0] * rng.random() if len(x) == 10 and i % 2 else 0.0 for i, x in enumerate(want)])
        who, which, found = shard.best(np.cumsum([0, *map(len, asks)]), np.concatenate(asks), np.concatenate(weights), floors, 10)
        for q, x in enumerate(want):
            got = sorted(zip((-found[who == q]).tolist(), which[who == q].tolist(), strict=True))[:10]
            assert [round(s, 9) for s, _ in got] == [round(s, 9) for s, _ in x]


def test_waves_and_shards_give_the_same_best(docs, monkeypatch):
    queries = docs.filter("doc_id % 20 = 0")
    answer = lambda: sorted((r.query_id, r.rank, key(r.doc_id), r.score) for r in topk_search.search(docs, queries, terms=None, min_df=1).collect())
    whole = answer()
    for name, value in (("SHARD_DOCS", 7), ("QUERIES", 2), ("WAVES", (4, 2)), ("BLOCK", 3)):
        monkeypatch.setattr(topk_search, name, value)
    assert answer() == whole


# ------------------------------------------------------------------ op5


def test_base_counts(docs, rows):
    got = {}
    for r in quality_rules.judge(docs).collect():
        got.setdefault(key(r.doc_id), []).append(r)
    for doc_id, text, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        repeated = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert want in [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got[key(doc_id)]]
        for r in got[key(doc_id)]:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert not (r.kept and r.base_failed)


@pytest.mark.parametrize(
    ("line", "fails"),
    [("A plain sentence.", False), ("no end", True), ("Home | About | Contact.", True), ("Licensed under the XYZ.", True), ("word%%% other*** more.", True), ("He said: “yes!”", False), ("A.", False)],
)
def test_line_rules(line, fails):
    assert quality_rules.line_fails(line) is fails


def test_clean_removes_lines_only_from_kept(spark):
    good = "A first sentence is here. It goes on, and on.\nHome | About | Contact\nA second one ends the text well."
    docs = spark.createDataFrame([(1, good, 7), (2, "bad " * 20, 8), (None, good, 9)], "doc_id long, text string, kept int")
    got = {r.doc_id: r for r in quality_rules.clean(docs).collect()}
    assert set(got) == {1, None} and "Home" not in got[1].text and got[None].kept == 9


# ------------------------------------------------------------------ op6


def test_packing_is_whole_and_aligned(docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    pieces = packing.pack(docs).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    assert all(p.length & (p.length - 1) == 0 and p.length <= 2048 and p.offset == 0 and 1 << p.bucket == p.length for p in pieces)
    assert all(zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 for p in pieces)
    by_doc = collections.defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p.sequence_id)):
        by_doc[key(p.doc_id)].append(p)
    want = collections.defaultdict(list)
    for doc_id, text, *_ in rows:
        want[key(doc_id)].append([*tok.encode(text or "", add_special_tokens=False).ids, 1])
    for doc_id, mine in by_doc.items():
        got, now = [], []
        for p in mine:
            if p.start == 0:
                now = []
                got.append(now)
            assert p.start == len(now)
            now += p.ids
            assert p.doc_tokens in [len(x) for x in want[doc_id]]
        assert sorted(got) == sorted(want[doc_id])


def test_piece_lengths():
    for n in [1, 2, 3, 2047, 2048, 2049, 10_000]:
        parts = packing.piece_lengths(n)
        assert sum(parts) == n and parts == sorted(parts, reverse=True)
    with pytest.raises(ValueError):
        packing.pack(None, most=100)


# ------------------------------------------------------------------ op8


def brute_components(rows):
    def print_of(text):
        import xxhash

        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        if not words:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [print_of(r[1]) for r in rows]
    label = list(range(len(rows)))
    while True:
        before = list(label)
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    best = {}
    for r, x in zip(rows, label):
        if r[0] is not None:
            best[x] = min(best.get(x, r[0]), r[0])
    return sorted((key(r[0]), format(p, "016x"), key(best.get(x))) for r, p, x in zip(rows, prints, label))


def test_simhash_components(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    assert sorted((key(r.doc_id), format(r.fp & (1 << 64) - 1, "016x"), key(r.component_id)) for r in got) == brute_components(rows)


@pytest.mark.parametrize("block", [1024, 8])
def test_ring_keys_lose_no_link(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for base in fps[:20]:
        for flips in (1, 2, 3, 3, 3, 4):
            fps.append(base ^ sum(1 << b for b in rng.sample(range(64), flips)))
    fps += [fps[0] ^ (a << 40) for a in range(40)]
    distinct = sorted(set(fps))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in distinct]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), 4)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    label = {x: x for x in distinct}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= 3:
            label[find(a)] = find(b)
    groups = lambda name: sorted(sorted(g) for g in name.values())
    want, got = collections.defaultdict(list), collections.defaultdict(list)
    for x, (s,) in zip(distinct, signed):
        want[find(x)].append(s)
        got[roots.get(s, s)].append(s)
    assert groups(want) == groups(got)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(200, 100)], "u long, v long")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(1, 61)}, 200: 100}


# ------------------------------------------------------------------ op9


def test_targets_share_and_stop():
    got = mixing.targets([("b", 100), (None, 50), ("a", 10), ("c", 0)])
    assert [x["source"] for x in got] == ["a", "b", "c", None]
    assert [x["weight"] for x in got] == [3, 1, 2, 3]
    assert got[0]["target"] == 20 and got[2]["target"] == 0 and got[3]["target"] == 100
    assert sum(x["target"] for x in got) == pytest.approx(1.5 * 160)


@pytest.mark.parametrize("chunk", [4096, 3])
def test_mix_meets_targets(docs, rows, chunk, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(mixing, "FAN_IN", 2 if chunk == 3 else 256)
    units = mixing.mix_units(docs).collect()
    again = mixing.mix_units(docs.repartition(7)).collect()
    assert sorted(map(str, units)) == sorted(map(str, again))
    assert sum(u.n for u in units) == len(rows)
    by_source = collections.defaultdict(list)
    for u in units:
        assert 0 <= u.copies <= 2
        by_source[u.source].append(u)
    for group in by_source.values():
        taken = sum(u.copies * u.size * u.n for u in group)
        assert abs(taken - group[0].target) <= max(u.size * u.n for u in group)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(u.copies * u.n for u in units)


def test_pivotal_rounding_keeps_sums_and_expectations():
    """Of each chunk the words stay, one row at most is left fractional, and over many draws every row's mean is its probability."""
    import pandas as pd

    rng = np.random.default_rng(4)
    size, p = rng.integers(1, 40, 9).astype(float), rng.random(9)
    total = np.zeros(9)
    for k in range(4000):
        rows = pd.DataFrame({"doc_id": range(9), "tie": 0, "size": size, "weight": size, "p": p, "chunk": 0, "level": 0})
        out = mixing._round_group((k, 0, 0), rows)
        mine = out["p"].to_numpy()
        assert abs((mine * size).sum() - (p * size).sum()) < 1e-9
        assert ((mine > 0) & (mine < 1)).sum() <= 1
        total += mine
    assert np.abs(total / 4000 - p).max() < 0.035  # four deviations of a mean of 4,000 draws


# ------------------------------------------------------------------ op10


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A title</h1><p>First &amp; best, of all.</p><p>Second\n  line<br>more.</p></article><footer>&copy; me</footer>", "A title First & best, of all. Second line more."),
        ("<article><p>One <b>bold</b>&nbsp;word.<script>if (a<b) x='</p>';</script><!-- no --><div class='ad'>Buy this thing now.</div><p>Two sentences. Are here.</article><div class=comments><p>Nice one!</p></div>", "One bold word. Two sentences. Are here."),
        ("<article><p>Broken <a href='x", "Broken"),
    ],
)
def test_extract(page, text):
    assert html_crf.main_text(page, html_crf.default_model()) == text


def test_field_on_held_out_layouts():
    model = html_crf.default_model()
    right = total = 0
    for page in html_crf.labelled_pages(60, seed=77):
        labels = html_crf.decode([b for b, _ in page], model)
        right += sum(a == b for a, (_, b) in zip(labels, page))
        total += len(page)
    assert right / total > 0.96


def test_viterbi_is_the_best_labelling():
    model = html_crf.default_model()
    for page in html_crf.labelled_pages(20, seed=5):
        blocks = [b for b, _ in page][:9]
        names = html_crf.features(blocks)
        score = [[sum(model[0].get(n, (0, 0))[y] for n in ns) for y in (0, 1)] for ns in names]
        value = lambda ys: sum(s[y] for s, y in zip(score, ys)) + sum(model[1][a, b] for a, b in zip(ys, ys[1:]))
        best = max(map(value, itertools.product((0, 1), repeat=len(blocks))))
        assert value(html_crf.decode(blocks, model)) == pytest.approx(best)


# ------------------------------------------------------------------ all of them


def test_queries_on_empty_tables(spark, tmp_path):
    for name, ddl in {"documents": "doc_id long, text string, lang string, source string, n_chars long", "pages": "page_id long, url string, html string", "labels": "doc_id long, quality int, toxic int"}.items():
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in registry.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
