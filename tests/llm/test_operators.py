"""Each operator against a brute-force version, a library or SQL, and on hard inputs."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from roadloom.llm import arrowtext, bpe_codec, compression_bands, gam_quality, language_id, latent_decontamination, line_dedup, parity_join, queries, substring_dedup, token_counts, toxicity_gru  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MULTI, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = [
    None, "", " \t\r\n ", "a", "\n\n\n", "one\ntwo\nthree\n", "one\ntwo\nthree", "one\r\ntwo\r\nthree\r\n", "a b c d e " * 4000, "word " * 30, "x" * 30_000, "Ünï cödé ÉÈ ß 日本語 テキスト 😀👍🏽",
    "1234567890 !!! ### | <|endoftext|> tail <|endoftext|>", "don't we'll I'VE  ", "\x00\x01\x7f nbsp line", "tie tie tie", "tie tie tie",
]


def frame(spark, texts, extra=True):
    """Documents with ids 0.. and columns whose names clash with internal ones; the second half of the rows repeats."""
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t or ""), 1, "x", [i]) for i, t in enumerate(texts)]
    cols = "doc_id long, text string, lang string, source string, n_chars long" + (", node int, _gone string, n array<int>" if extra else "")
    return spark.createDataFrame([r[: 8 if extra else 5] for r in rows], cols)


@pytest.fixture(scope="module")
def odd(spark):
    df = frame(spark, ODD)
    return df.union(df.where("doc_id in (5, 8)")).union(df.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def made_up(seed, n=80, vocabulary=40, copies=True):
    """Short texts over few words, with copies and shared passages."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    out = []
    for _ in range(n):
        if copies and out and rng.random() < 0.4:
            t = rng.choice(out).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):
                t[rng.randrange(len(t))] = rng.choice(words)
            cut = rng.randrange(len(t)) if rng.random() < 0.4 else 0
            t = t[cut:] + rng.choice([[], rng.choice(out).split(" ")[:25]])
        else:
            t = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 19, 20, 21, 40, 120]))]
        out.append(" ".join(t) or "w0")
    return out


# Token counts and byte-level BPE


def test_counts_equal_library(odd, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(JSON)
    for df in (odd, docs):
        text = {r.doc_id: r.text or "" for r in df.collect()}
        for r in token_counts.token_counts(df, JSON, P.PATTERN).collect():
            t = text[r.doc_id]
            n = len(lib.encode(t, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)


def test_prefix_table():
    """The stored prefix counts are those of the prefixes, within pre-tokens too, and answer budgets."""
    c = token_counts.PrefixCounter(JSON, P.PATTERN)
    for piece in ("misunderstandings", " Kraftfahrzeug", "aaaaaaaaaaaaaaaa", "日本語テ"):
        data = piece.encode()
        for i, n in enumerate(c.prefixes(data)):
            merged, parts = c.merged(data[:i]), []
            assert n == len(merged if i else parts)
    text = "the quick brown fox jumps over it"
    assert c.table(text)[-1] == c.count(text) and len(c.table(text)) == len(text) + 1
    at = c.fits(text, 3)
    assert c.count(text[:at]) <= 3 < c.count(text[: at + 6])


def test_codec_equals_library(odd, docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (odd, docs):
        text = {r.doc_id: r.text or "" for r in df.collect()}
        for r in bpe_codec.encode_documents(df, MULTI, P.PATTERN, with_ids=True).collect():
            ids = lib.encode_ordinary(text[r.doc_id])
            assert r.ids == ids and r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_perfect_hash():
    keys = [str(i).encode() for i in range(5000)] + [b""]
    h = bpe_codec.PerfectHash(keys)
    slots = h.slot(bpe_codec.fingerprints(keys))
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert h.find(bpe_codec.fingerprints(keys)).tolist() == list(range(len(keys)))
    assert (h.find(bpe_codec.fingerprints([f"x{i}".encode() for i in range(5000)])) == -1).all()


def test_merging_in_step(monkeypatch):
    """Pre-tokens that are merged many at a time have the ids that a heap each gives, of any length and of any bytes; few
    are left to a heap of their own."""
    c = bpe_codec.Codec(MULTI, P.PATTERN)
    rng = random.Random(4)
    raw = [*{bytes(rng.choice((b"aeinrst", b"ab", bytes(range(256)))[i % 3]) for _ in range(rng.randrange(1, 70))) for i in range(3000)}, *(b"a" * n for n in range(70)), *(b"tie" * n for n in range(1, 30))]
    for width in bpe_codec.WIDTHS:
        some = [d for d in raw if len(d) <= width]
        ids, n = c.merge_all(some, width)
        assert [r.tolist() for r in np.split(ids, np.cumsum(n)[:-1])] == [c.merge(d) for d in some]
    calls, alone = [0], c.merge
    monkeypatch.setattr(c, "merge", lambda data: calls.__setitem__(0, calls[0] + 1) or alone(data))
    words = {"".join(rng.choice("aeinrstlo") for _ in range(rng.randrange(6, 30))) for _ in range(5000)}
    c.encode_all([" ".join(words)])
    assert calls[0] < 200
    long = ["x" * 30_000, "ab" * 500 + "c", "日本" * 40]
    assert [c.encode(t) for t in long] == [alone(t.encode()) for t in long] and calls[0] < 210
    assert [c.decode(c.encode(t)).decode() for t in (*long, "", "a\n")] == [*long, "", "a\n"]


def test_memo_keeps_frequent(monkeypatch):
    """Frequent pre-tokens aren't resolved again when the memo is full, and ids stay right across generations."""
    monkeypatch.setattr(bpe_codec, "MEMO", 100)
    c = bpe_codec.Codec(MULTI, P.PATTERN)
    asked, find = [0], c.hash.find
    monkeypatch.setattr(c.hash, "find", lambda prints: asked.__setitem__(0, asked[0] + len(prints)) or find(prints))
    common = " ".join(f"{a}{b}zq" for a in "abcdef" for b in "ghijklmn")
    for i in range(12):
        text = common + "".join(f" {'qx' * (i + 1)}{chr(97 + j)}" for j in range(26))
        c.encode_all([text, "", common])
        assert c.encode(text) == [k for piece in c.find(text) for k in c.merge(piece.encode())]
    assert asked[0] <= 50 + 12 * 26


# Substring and line deduplication


def brute_substrings(rows):
    seen, out = {}, {}
    lists = {d: WORD.findall(t or "") for d, t in rows}
    for d in sorted(lists):
        for i in range(len(lists[d]) - 19):
            seen.setdefault(tuple(lists[d][i : i + 20]), (d, i))
    for d, w in lists.items():
        cut = set()
        for i in range(len(w) - 19):
            if seen[tuple(w[i : i + 20])] < (d, i):
                cut |= set(range(i, i + 20))
        out[d] = len(w), len(cut), " ".join(x for i, x in enumerate(w) if i not in cut)
    return out


@pytest.mark.parametrize("hot", [False, True, "many"])
def test_substrings(spark, odd, monkeypatch, hot):
    if hot == "many":  # the split by exact counts, with little memory of what was seen
        monkeypatch.setattr(substring_dedup, "MANY", 2)
        monkeypatch.setattr(substring_dedup, "HELD", 30)
    elif hot:  # the split of frequent anchors, at a size that a test can have
        monkeypatch.setattr(substring_dedup, "HOT_EVERY", 2)
        monkeypatch.setattr(substring_dedup, "HOT_LEAST", 2)
    for df in (frame(spark, made_up(1)), frame(spark, made_up(2, vocabulary=3)), odd.where("doc_id is not null")):
        want = brute_substrings([(r.doc_id, r.text) for r in df.collect()])
        for r in substring_dedup.substring_dedup(df.repartition(3)).collect():
            assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id]


def test_substrings_of_null_ids(odd):
    rows = substring_dedup.substring_dedup(odd).where("doc_id is null").collect()
    assert [(r.n_removed, r.kept) for r in rows] == [(0, "one two three")]


def test_automaton():
    """Matching statistics against a search in all that came before."""
    rng = random.Random(5)
    for _ in range(30):
        automaton, before = substring_dedup.Automaton(), []
        for _ in range(4):
            seg = [rng.choice("ab") for _ in range(rng.randrange(1, 14))]
            got = automaton.stream(seg)
            for e, n in enumerate(got):
                def known(k):
                    run = seg[e + 1 - k : e + 1]
                    return any(x[i : i + k] == run for x in before for i in range(len(x) - k + 1)) or any(seg[i : i + k] == run for i in range(e - k + 1))
                assert n == max(k for k in range(e + 2) if k == 0 or known(k))
            before.append(seg)


def brute_lines(rows):
    seen, out = {}, {}
    parts = {d: (t or "").split("\n") for d, t in rows}
    worded = {d: [i for i, x in enumerate(p) if WORD.search(x)] for d, p in parts.items()}
    for d in sorted(parts):
        for j in range(len(worded[d]) - 2):
            seen.setdefault(tuple(parts[d][i] for i in worded[d][j : j + 3]), (d, j))
    for d, p in parts.items():
        cut = set()
        for j in range(len(worded[d]) - 2):
            if seen[tuple(p[i] for i in worded[d][j : j + 3])] < (d, j):
                cut |= set(worded[d][j : j + 3])
        out[d] = len(worded[d]), len(cut), "\n".join(x for i, x in enumerate(p) if i not in cut)
    return out


def test_lines(spark, odd):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["a", "b", "c c", "", " ", "d\t"]) for _ in range(rng.randrange(14))) for _ in range(60)]
    for df in (frame(spark, texts), odd.where("doc_id is not null")):
        text = {r.doc_id: r.text for r in df.collect()}
        want = brute_lines(text.items())
        got = line_dedup.line_dedup(df.repartition(3))
        assert got.columns == [*df.columns, "n_lines", "n_removed"]
        for r in got.collect():
            assert (r.n_lines, r.n_removed, r.text or "") == want[r.doc_id] and (r.text is None) == (text[r.doc_id] is None)
    (r,) = line_dedup.line_dedup(odd).where("doc_id is null").collect()
    assert (r.n_lines, r.n_removed) == (3, 0)


# Quality rules


def test_compression_bands(odd, docs):
    packer = zstandard.ZstdCompressor(level=3)
    for df in (odd, docs):
        text = {r.doc_id: r.text or "" for r in df.collect()}
        for r in compression_bands.compression_bands(df).collect():
            t = text[r.doc_id]
            w = WORD.findall(t)
            runs = Counter(zip(w, w[1:], w[2:]))
            cover = {j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
            lines = Counter(x for x in t.split("\n") if WORD.search(x))
            assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"))
            assert (r.n_dup_lines, r.n_repeat_words) == (sum(n - 1 for n in lines.values()), len(cover))
            assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)
            raw = t.encode()
            assert r.ratio == (len(raw) / len(packer.compress(raw)) if raw else 1.0)


def test_bands_keep_good_documents(spark):
    at = "/root/testdata/sf0.01"
    d = compression_bands.compression_bands(spark.read.parquet(f"{at}/documents.parquet")).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id")
    rows = d.where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.5


def test_bands_of_chunks(spark):
    """Noise or repetition in a minority of a long text is caught by the chunks, where the whole stays in its band."""
    base = compression_bands.compression_bands(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) between 8000 and 30000")).where("kept").select("doc_id")
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(base, "doc_id").orderBy("doc_id").limit(60).collect()]
    rng, rows, missed = random.Random(9), [], 0
    noise = lambda n: " ".join(base64.b64encode(rng.randbytes(6)).decode() for _ in range(n // 9 + 1))[:n]
    again = lambda n: (texts[0][:40] * (n // 40 + 1))[:n]
    for k, t in enumerate(texts):
        cut = len(t) * 7 // 10
        rows += [(4 * k, t), (4 * k + 1, t[:cut] + noise(len(t) - cut)), (4 * k + 2, noise(len(t) - cut) + t[len(t) - cut :]), (4 * k + 3, t[:cut] + again(len(t) - cut))]
    got = {r.doc_id: r for r in compression_bands.compression_bands(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(texts) > 40
    for d, t in rows:
        low, high = compression_bands.limits(compression_bands.BANDS, np.array([len(t.encode())]))
        assert got[d].kept == (d % 4 == 0)
        missed += d % 4 > 0 and not got[d].base_failed and low[0] <= got[d].ratio <= high[0]
    assert missed > 60  # that only the chunks catch
    packer = zstandard.ZstdCompressor(level=3)
    prose, tail = texts[0].encode()[: 3 * 2048], noise(900).encode()
    assert compression_bands.ratios(prose, packer)[1] == 0 and compression_bands.ratios(prose + tail, packer)[1] == 900 / (3 * 2048 + 900)


# Near duplicates


def brute_components(rows):
    sets, root = {}, {}
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        root[d] = d

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("small", [2, 16])
def test_parity_join(spark, odd, monkeypatch, small):
    monkeypatch.setattr(parity_join, "SMALL", small)  # 2: groups of three already count as large
    monkeypatch.setattr(parity_join, "CLOSE", 3 if small == 2 else 2048)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(160)]
    family = [" ".join(x if rng.random() > 0.02 else f"e{rng.randrange(9**9)}" for x in base) for _ in range(60)]
    for df in (frame(spark, family + made_up(4, n=60, vocabulary=500)), odd.where("doc_id is not null")):
        want = brute_components([(r.doc_id, r.text) for r in df.collect()])
        for r in parity_join.parity_join(df.repartition(4)).collect():
            assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_hashes_in_pieces():
    """The hash of a range depends on its bytes only, short or long, and takes little memory beside the block."""
    rng = np.random.default_rng(5)
    size = [3, 1, arrowtext.PIECE - 1, arrowtext.PIECE, 7, arrowtext.PIECE + 1, 2, 3 * arrowtext.PIECE, 1_000_003, 5]
    data = rng.integers(33, 127, sum(size) + len(size), np.uint8)
    start = np.cumsum([0, *(n + 1 for n in size[:-1])])
    tracemalloc.start()
    got = arrowtext.Block(data, np.array([0, len(data)]), None).hashes(start, start + size, seed=4321)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    table, powers = arrowtext._table(4321)
    for h, a, n in zip(got.tolist(), start.tolist(), size, strict=True):
        up, total = 1, 0
        for v in table[data[a : a + n]].tolist() if n < 2 * arrowtext.PIECE else ():
            total, up = total + v * up, up * powers.base % (1 << 64)
        alone = arrowtext.Block(data[a : a + n], np.array([0, n]), None).hashes(np.array([0]), np.array([n]), seed=4321)[0]
        assert h == alone
        assert n >= 2 * arrowtext.PIECE or h == arrowtext.mix(np.array([(total + n * int(arrowtext._ODD)) % (1 << 64)], np.uint64))[0]
    assert peak < 4 << 20


def test_one_bucket_a_task(docs):
    """A task of the grouping holds the keys of one bucket, and none is lost."""
    packed = parity_join.packed_keys(docs, 64)
    dealt = parity_join.by_bucket(packed, 64).select("bucket", F.spark_partition_id().alias("task"))
    assert max(Counter(r.task for r in dealt.distinct().collect()).values()) == 1
    assert dealt.count() == packed.count() >= 64


def test_workers_give_memory_back():
    """What a task has freed in its worker does not stay there: workers live on, and count against their executor."""
    own = lambda: sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon")) >> 10
    kept = []

    def use(batches):
        for batch in batches:
            held = [np.ones(12_000) for _ in range(2000)]  # 192 MB in pieces that the allocator keeps
            kept.append(np.ones(12_000))
            held.clear()
            yield batch

    before = own()
    assert list(arrowtext.trimming(use)(iter(["batch"]))) == ["batch"]
    assert own() - before < 60


def test_parity_join_of_null_ids(odd):
    assert [r.component_id for r in parity_join.parity_join(odd).where("doc_id is null").collect()] == [None]


def test_pigeonhole():
    """Linked sets share a key, whatever their sizes; sketches never claim more difference than there is."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 55, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.25], rng.integers(0, 1 << 55, int(rng.integers(0, max(1, n // 6)))).astype(np.uint64)]))
        if not len(b):
            continue
        both, apart = len(np.intersect1d(a, b)), len(np.setxor1d(a, b))
        made = [parity_join.part_keys(x, np.array([0, len(x)]), np.array([0])) for x in (a, b)]
        if 100 * both >= 75 * len(np.union1d(a, b)):
            assert len(set(made[0][1].tolist()) & set(made[1][1].tolist())) >= max(made[0][2][0], made[1][2][0])
        raw = [parity_join.sketch(x) for x in (a, b)]
        bits = 8 * min(map(len, raw))
        assert int(np.bitwise_count(parity_join.fold(raw[0], bits) ^ parity_join.fold(raw[1], bits)).sum()) <= apart


# Decontamination


def test_decontamination(spark, docs):
    """All verbatim passages, most paraphrases, and nothing else."""
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rng, items = random.Random(1), bench.collect()
    hosts = [r.text.split() for r in docs.limit(len(items)).collect()]
    clean = latent_decontamination.contaminated(docs, bench)
    already = {r.doc_id for r in clean.collect()}
    words = [w for h in hosts for w in h]
    rows, want = [], {}
    for k, item in enumerate(items):
        w, host = item.text.split(), hosts[k][:400]
        at = rng.randrange(len(host) + 1)
        para = [x if rng.random() > 0.2 else rng.choice(words) for x in w]
        rows += [(10_000 + k, " ".join(host[:at] + w + host[at:])), (20_000 + k, " ".join(host[:at] + para + host[at:]))]
        want[10_000 + k] = want[20_000 + k] = item.item_id
    got = latent_decontamination.contaminated(docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")), bench).collect()
    hit = {(r.doc_id, r.item_id) for r in got}
    exact = [(d, i) in hit for d, i in want.items() if d < 20_000]
    para = [(d, i) in hit for d, i in want.items() if d >= 20_000]
    assert all(exact) and np.mean(para) >= 0.9
    # Brute force over normalised words finds the same documents among those that were there before.
    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    brute = {r.doc_id for r in docs.collect() if any(norm(i.text) in norm(r.text or "") for i in items)}
    assert already == brute
    assert {r.doc_id for r in latent_decontamination.clean_documents(docs, bench).collect()} == {r.doc_id for r in docs.collect()} - brute


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    """More passages than one block holds give the same pairs."""
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = {(r.doc_id, r.item_id) for r in latent_decontamination.contaminated(docs, bench).collect()}
    monkeypatch.setattr(latent_decontamination, "ITEMS", 24)
    assert {(r.doc_id, r.item_id) for r in latent_decontamination.contaminated(docs, bench).collect()} == want


def test_decontamination_of_one_text_in_many_items(spark, monkeypatch):
    """Items that share a text don't crowd others out of a block, and each is reported."""
    monkeypatch.setattr(latent_decontamination, "ITEMS", 24)
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(30))
    items = [(k, text()) for k in range(60)] + [(100 + k, "one text " + "of many items here " * 5) for k in range(30)]
    hosts = [(k, f"{text()} {t} {text()}") for k, t in items if k <= 100] + [(200 + k, text()) for k in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(hosts, "doc_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in latent_decontamination.contaminated(docs, bench).collect())
    assert got == Counter([(k, k) for k in range(60)] + [(100, 100 + k) for k in range(30)])
    assert {r.doc_id for r in latent_decontamination.clean_documents(docs, bench).collect()} == {200 + k for k in range(20)}


def test_decontamination_recall_of_copies(spark):
    """No verbatim copy of a thousand short passages is lost, whatever the latent space keeps of them."""
    texts = [r.text.split() for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) between 800 and 8000").orderBy("doc_id").limit(2000).collect()]
    rng, items, rows = random.Random(6), [], []
    for k, (source, host) in enumerate(zip(texts[:1000], texts[1000:], strict=True)):
        n = rng.randrange(15, 60)
        at, to = rng.randrange(len(source) - n + 1), rng.randrange(len(host) + 1)
        items.append((k, " ".join(source[at : at + n])))
        rows.append((k, " ".join(host[:to] + source[at : at + n] + host[to:])))
    got = latent_decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(k, k) for k in range(1000)}


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        places = latent_decontamination.positions(a)
        assert latent_decontamination.common_subsequence(len(a), [places[x] for x in b if x in places]) == best[-1][-1]


def test_randomised_svd(spark):
    """The latent space keeps what a full decomposition keeps."""
    bench = latent_decontamination.item_passages(spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
    bodies = sorted(bytes(r.body) for r in bench.collect())
    block = latent_decontamination.block_of(bodies)
    vocabulary = latent_decontamination.Vocabulary(latent_decontamination.hash_words(block, block.words()))
    idf = np.ones(len(vocabulary.hashes))
    row, word, weight = latent_decontamination.passage_matrix(bodies, vocabulary, idf)
    a = np.zeros((len(bodies), len(idf)))
    a[row, word] = weight
    v = latent_decontamination.randomised_svd(bench, vocabulary, idf, 10)
    best = np.linalg.svd(a, compute_uv=False)[:10]
    assert np.linalg.norm(a @ v) >= 0.97 * np.linalg.norm(best)


# Classifiers


def accuracy(rows, truth, want):
    return np.mean([truth[r.doc_id] == want(r) for r in rows if r.doc_id in truth])


def test_language(spark, odd):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op9_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in d.collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and accuracy(held, lang, lambda r: r.lang_pred) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r.lang_pred for r in language_id.language_id(odd, d).collect()}
    assert {got[i] for i in (0, 1, 2, 4)} == {"und"} and got[3] != "und"
    assert {r.lang_pred for r in language_id.language_id(odd, d.limit(0)).collect()} == {"und"}


def test_quality(spark, odd, labels):
    rows = queries.op10_gam_quality(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert accuracy([r for r in rows if r.held_out], truth, lambda r: r.predicted) > 0.97
    assert all((r.predicted == 1) == (r.score >= 0.5) for r in rows)
    named = labels.select("doc_id", F.col("quality").alias("label"))
    assert gam_quality.quality_scores(odd, named).count() == odd.count()
    assert {r.score for r in gam_quality.quality_scores(odd, named.limit(0)).collect()} == {0.5}
    assert gam_quality.accepted(odd, named.limit(0)).count() == odd.count()


def test_additive_model():
    """Main effects and an interaction are learnt."""
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam_quality.Additive().fit(x[:2000], y[:2000])
    assert np.mean((model.scores(x[2000:]) >= 0.5) == (y[2000:] == 1)) > 0.9


def test_toxicity(spark, odd, labels):
    rows = queries.op6_toxicity_gru(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert accuracy(held, truth, lambda r: r.predicted) > 0.85
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and (r.predicted == 1) == (r.score >= 0.3) for r in rows)
    named = labels.select("doc_id", F.col("toxic").alias("label"))
    assert {r.score for r in toxicity_gru.toxicity_scores(odd, named.limit(0)).collect()} == {0.0}


def test_pieces():
    """Every byte of a long word is in a piece, and every n-gram too."""
    sizes = [1, 47, 48, 49, 89, 90, 500, 3]
    block = toxicity_gru.block_of([b" ".join(b"a" * n for n in sizes[:4]), b"", b" ".join(b"b" * n for n in sizes[4:])])
    words = toxicity_gru.bare_words(block)
    got = toxicity_gru.pieces(words)
    assert (got.end - got.start).max() == 48 and got.ptr[0] == 0 and got.ptr[1] == got.ptr[2] and got.ptr[-1] == len(got.start)
    want = {p for a, b in zip(words.start, words.end, strict=True) for p in range(a, max(a + 1, b - 3))}
    assert {p for a, b in zip(got.start, got.end, strict=True) for p in range(a, max(a + 1, b - 3))} == want
    assert np.all(np.diff(got.start) > 0) and np.all(np.diff(got.end) > 0)
    assert [int((got.start < words.start[words.ptr[2]]).sum()), len(got.start)] == [5, 5 + 2 + 3 + 13 + 1]


def test_toxicity_without_spaces():
    """In texts that are one word a phrase tells, wherever it stands."""
    rng = random.Random(12)
    clean = lambda n: "".join(chr(rng.randrange(0x4E00, 0x4E3C)) for _ in range(n))
    rows = [(clean(rng.randrange(20, 200)) + ("毒舌惡言罵人" if k % 2 else "") + clean(rng.randrange(20, 200))).encode() for k in range(1500)]
    net = toxicity_gru.part_of_training([(x, k % 2) for k, x in enumerate(toxicity_gru.bare_texts(toxicity_gru.block_of(rows[:1000])))], toxicity_gru.FOLDS)
    score = net.scores(toxicity_gru.block_of(rows[1000:]))
    assert (score[1::2, None] > score[None, ::2]).mean() > 0.9


def test_gradients():
    """Backpropagation against differences."""
    rng = np.random.default_rng(0)
    net = toxicity_gru.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, at, mask = rng.standard_normal((7, 3 * toxicity_gru.WIDTH)), rng.integers(0, 7, (3, 5)), np.ones((3, 5))
    mask[1, 3:] = 0
    d = rng.standard_normal(3)
    keep: dict = {}
    net.logits(x, at, mask, keep)
    grads, dx = net.backward(keep, d)
    for name in ("xf", "ub", "cf", "att", "att_v", "out", "xb", "uf"):
        i = tuple(int(rng.integers(0, k)) for k in net.p[name].shape)
        net.p[name][i] += 1e-5
        up = net.logits(x, at, mask) @ d
        net.p[name][i] -= 2e-5
        down = net.logits(x, at, mask) @ d
        net.p[name][i] += 1e-5
        assert abs((up - down) / 2e-5 - grads[name][i]) < 1e-3 * max(1, abs(grads[name][i]))
    x[2, 4] += 1e-5
    up = net.logits(x, at, mask) @ d
    x[2, 4] -= 2e-5
    assert abs((up - net.logits(x, at, mask) @ d) / 2e-5 - dx[2, 4]) < 1e-3


# All of them


def test_empty_tables(spark, odd, labels):
    none = odd.limit(0)
    named = labels.select("doc_id", F.col("toxic").alias("label"))
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (
        token_counts.token_counts(none, JSON, P.PATTERN), bpe_codec.encode_documents(none, MULTI, P.PATTERN), substring_dedup.substring_dedup(none), line_dedup.line_dedup(none), compression_bands.compression_bands(none),
        toxicity_gru.toxicity_scores(none, named), parity_join.parity_join(none), latent_decontamination.contaminated(none, bench), latent_decontamination.contaminated(odd, bench), language_id.language_id(none, none), gam_quality.quality_scores(none, named),
    ):
        assert df.count() == 0


def test_rows_stay(spark, odd, labels):
    """One row for every input row where that is promised."""
    named = labels.select("doc_id", F.col("toxic").alias("label"))
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (token_counts.token_counts(odd, JSON, P.PATTERN), substring_dedup.substring_dedup(odd), line_dedup.line_dedup(odd), compression_bands.compression_bands(odd), parity_join.parity_join(odd), language_id.language_id(odd, d), toxicity_gru.toxicity_scores(odd, named)):
        assert Counter(r.doc_id for r in df.select("doc_id").collect()) == Counter(r.doc_id for r in odd.collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(name, spark, small, same):
    assert same(queries.QUERIES[name], queries.ORACLE_SQL[name], spark, small) == 200


def test_pipeline(spark, small, docs):
    """Stage by stage against brute force on what the stage before kept."""
    import corpus_pipeline

    kept, rows = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in kept.collect()}
        out = stage(spark, kept, small)
        got = {r.doc_id: r for r in out.collect()}
        if name != "tokens":
            assert out.columns == docs.columns and set(got) <= set(before)
        if name == "lines":
            want = brute_lines((d, r.text) for d, r in before.items())
            assert {d: r.text for d, r in got.items()} == {d: t for d, (_, cut, t) in want.items() if not cut or WORD.search(t)}
            assert all(r.n_chars == len(r.text) for r in got.values())
        elif name == "near_duplicates":
            want = brute_components((d, r.text) for d, r in before.items())
            assert set(got) == {d for d, (_, root) in want.items() if d == root}
        elif name == "decontamination":
            assert set(before) - set(got) == {r.doc_id for r in latent_decontamination.contaminated(kept, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
        elif name == "tokens":
            assert set(got) == set(before)
            assert all(r.decoded_sha256 == hashlib.sha256((before[d].text or "").encode()).hexdigest() for d, r in got.items())
        rows[name] = got
        kept = spark.createDataFrame(list(got.values()), out.schema)
    end = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, small).collect()}
    assert end == {d: r.ids_sha256 for d, r in rows["tokens"].items()}
