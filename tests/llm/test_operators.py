"""Each operator against its plain version, and on nulls, empty texts, ties, repeats,
empty tables and columns with clashing names."""

import hashlib
import math
import random
import zlib
from base64 import b32encode
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixlake.llm import _shared, exact_dedup, langid, mixing, packing, pii, queries, simhash, substring_dedup, topk, toxicity, warc_store

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n, size=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randint(0, size)}" for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls everywhere, empty and blank texts, repeats, a long text, odd white space."""
    long = words(1, 4000)
    rows = [
        (1, "Alpha beta gamma delta", "en", "a", 5),
        (2, "Alpha beta gamma delta", "en", "a", None),
        (2, "Alpha beta gamma delta", "en", "a", None),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, "   \n\t ", None, "b", 1),
        (6, long, "de", "c", 1),
        (7, long + " tail", "de", "c", 1),
        (8, "tab\tand\nbreak  double  \r\nend ", "fr", "é", 1),
        (9, "日本 語 テキスト", "ja", "é", 1),
        (None, "Alpha beta gamma delta", None, None, None),
        (10, "a a a a a a " * 60, "en", "a", 1),
        (11, "a a a a a a " * 55, "en", "a", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def clashing(awkward):
    names = ["row", "key", "sha", "kept", "size", "copies", "source_size", "target", "fp", "_lost0", "_id", "_len", "score", "doc", "payload", "copy"]
    return awkward.select("*", *[F.lit(n).alias(n) for n in names])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def order(rows):
    return sorted(rows, key=repr)


# ---- exact dedup -----------------------------------------------------------------------------


def test_exact_dedup(spark, awkward, clashing, none):
    for df in (awkward, clashing):
        got = exact_dedup.exact_dedup(df, digest_all=True).collect()
        groups = defaultdict(list)
        for d, t in rows_of(awkward):
            groups[hashlib.sha256((t or "").encode()).hexdigest()].append(d)
        keep = {h: max((d for d in g if d is not None), default=None) for h, g in groups.items()}
        assert order((r.doc_id, r.text_sha256, r.keep_id, r.group_size) for r in got) == order((d, h, keep[h], len(g)) for h, g in groups.items() for d in g)
        assert Counter(r.text_sha256 for r in got if r.kept) == Counter(groups.keys())
    lean = exact_dedup.exact_dedup(awkward).collect()
    assert all(r.text_sha256 is not None for r in lean if r.group_size > 1) and any(r.text_sha256 is None for r in lean)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_the_kept_row_of_repeated_rows_does_not_depend_on_their_order(spark):
    rows = [(1, "same", s) for s in ("web", "books", "news", None)] + [(2, "other", "web"), (None, "none", "b"), (None, "none", "a")]
    for seed in range(3):
        mixed = random.Random(seed).sample(rows, len(rows))
        df = spark.createDataFrame(mixed, "doc_id long, text string, source string").repartition(4)
        kept = sorted(exact_dedup.drop_exact_copies(df).collect(), key=str)
        assert sorted(map(tuple, kept), key=str) == sorted([(1, "same", "books"), (2, "other", "web"), (None, "none", "a")], key=str)


def test_dropping_exact_copies_keeps_one_row_each(awkward, clashing, none):
    for df in (awkward, clashing):
        kept = exact_dedup.drop_exact_copies(df)
        assert kept.columns == df.columns
        texts = [t or "" for _, t in rows_of(kept)]
        assert sorted(texts) == sorted({t or "" for _, t in rows_of(awkward)})
        assert (2, "Alpha beta gamma delta") in rows_of(kept)
    assert exact_dedup.drop_exact_copies(none).count() == 0


# ---- mixing ----------------------------------------------------------------------------------


def plain_targets(sizes):
    order_ = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order_)}
    cap = {s: 3.0 * sizes[s] for s in order_}
    stopped: set = set()
    while True:
        open_ = [s for s in order_ if s not in stopped]
        left = sum(sizes.values()) - sum(cap[s] for s in stopped)
        target = {s: cap[s] if s in stopped else left * weight[s] / sum(weight[x] for x in open_) for s in order_}
        over = {s for s in open_ if target[s] > cap[s]}
        if not over:
            return target
        stopped |= over


def test_mixing_targets_and_copies(spark, awkward, clashing, none):
    for df in (awkward, clashing):
        got = mixing.mix_rates(df).collect()
        size = defaultdict(int)
        for r in awkward.collect():
            size[r.source] += len(brute.WORD.findall(r.text or ""))
        want = plain_targets(dict(size))
        for r in got:
            assert r.size == len(brute.WORD.findall(r.row.text or "")) and r.source_size == size[r.row.source]
            assert r.target == pytest.approx(want[r.row.source])
            rate = want[r.row.source] / size[r.row.source] if size[r.row.source] else 0
            assert math.floor(rate) <= r.copies <= min(3, math.floor(rate) + 1)
        mix = mixing.mixed(df)
        assert mix.columns == df.columns and mix.count() == sum(r.copies for r in got)
        assert order(mix.collect()) == order(mixing.mixed(df).collect())
    assert mixing.mixed(none).count() == 0


def test_mixing_comes_near_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, words(i, rng.randint(5, 40)), "en", rng.choice(["s", "t", "u"]) if i % 3 else "s", 1) for i in range(2500)]
    got = mixing.mix_rates(spark.createDataFrame(rows, DOCS)).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.row.source] += r.size * r.copies
        target[r.row.source] = r.target
    assert all(taken[s] == pytest.approx(target[s], rel=0.08) for s in target)
    assert sum(target.values()) == pytest.approx(sum(r.size for r in got))


# ---- WARC ------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    schema = "page_id long, url string, html string, payload string, header string"
    rows = [(1, "http://a/ x\r\n", "<p>é</p>", "p", "h"), (2, "http://b", "<p>é</p>", None, None), (3, None, None, None, None), (4, "u", "", None, None), (5, "v", "only", None, None), (5, "v", "only", None, None), (None, "w", "only", None, None), (6, "z", "x\r\n\r\ny", None, None)]
    got = warc_store.read_archive(warc_store.write_archive(spark.createDataFrame(rows, schema))).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
        assert r.payload_digest == b32encode(hashlib.sha1(r.payload).digest()).decode()
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert body == (bytes(r.payload) if r.record_type == "response" else b"") + b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
    heads = [bytes(r.record).partition(b"\r\n\r\n")[0].decode().split("\r\n") for r in got]
    ids = [x for h in heads for x in h if x.startswith("WARC-Record-ID: ")]
    assert len(set(ids)) == len(rows) and all(any(x.startswith("WARC-Date: ") for x in h) for h in heads)
    named = {x.split(": ")[1] for x in ids}
    assert all(x.split(": ")[1] in named for h in heads for x in h if x.startswith("WARC-Refers-To: "))
    assert [bytes(by[i][0].payload) for i in (1, 3, 6)] == ["<p>é</p>".encode(), b"", b"x\r\n\r\ny"]
    assert (by[1][0].record_type, by[1][0].refers_to, by[2][0].record_type) == ("revisit", 2, "response")
    assert sorted(r.record_type for r in by[5]) == ["response", "revisit"] and by[None][0].refers_to == 5
    assert (by[3][0].refers_to, by[3][0].target_uri, by[1][0].target_uri) == (4, None, "http://a/%20x%0D%0A")
    least = warc_store.read_archive(warc_store.write_archive(spark.createDataFrame(rows, schema), least_revisit_bytes=5)).collect()
    assert Counter(r.record_type for r in least) == {"response": 7, "revisit": 1}
    assert warc_store.read_archive(warc_store.write_archive(spark.createDataFrame([], schema))).count() == 0


def test_warc_notices_a_wrong_payload(spark, tmp_path):
    archive = warc_store.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"))
    warc_store.save_archive(archive, str(tmp_path / "w"))
    loaded = warc_store.load_archive(spark, str(tmp_path / "w"))
    assert warc_store.read_archive(loaded).count() == 1
    wrong = warc_store.Archive(loaded.payloads.withColumn("payload", F.lit(b"abd")), loaded.headers)
    with pytest.raises(Exception, match="does not match"):
        warc_store.read_archive(wrong).collect()


# ---- SimHash ---------------------------------------------------------------------------------


def test_simhash_groups(awkward, clashing, none):
    for df in (awkward, clashing):
        got = [(r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in simhash.near_groups(df).collect()]
        assert order(got) == order(brute.near_groups(rows_of(awkward)))
        assert simhash.drop_near_copies(df).columns == df.columns
    assert simhash.near_groups(none).count() == 0 and simhash.drop_near_copies(none).count() == 0


@pytest.mark.parametrize(("radius", "segments"), [(4, 3), (4, 2), (3, 4), (7, 4), (0, 2)])
def test_links_find_every_near_pair(spark, radius, segments):
    rng = random.Random(radius * 10 + segments)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(6):
            f = base
            for b in rng.sample(range(64), rng.randint(0, radius + 2)):
                f ^= 1 << b
            prints.add(f)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    nodes = spark.createDataFrame([(signed(f),) for f in prints], "fp long")
    links = simhash.near_links(nodes, radius, segments)
    got = {r.node: r.root for r in simhash.components(links).collect()} if links.count() else {}
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    mine, want = defaultdict(set), defaultdict(set)
    for f in prints:
        mine[got.get(signed(f), signed(f))].add(f)
        want[find(f)].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(21)
    rows, kept = [], set()
    for g in range(40):
        base = words(g, 150, 5000).split()
        kept.add(g * 10)
        for j in range(4):
            t = list(base)
            for _ in range(j):
                t[rng.randrange(150)] = f"new{rng.random()}"
            rows.append((g * 10 + j, " ".join(t)))
    got = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept <= got and len(got - kept) <= 4  # up to three of 150 words changed


def test_alike_groups_are_those_of_exact_similarity(spark):
    rng = random.Random(5)
    rows = []
    for g in range(30):
        base = words(900 + g, rng.choice([3, 12, 40, 200]), 3000).split()
        for j in range(12):
            t = list(base)
            for _ in range(rng.randint(0, len(t) // 12 + 1)):
                k = rng.randrange(len(t))
                t[k : k + rng.randint(0, 1)] = [f"v{rng.randint(0, 9)}"]
            rows.append((100 * g + j, " ".join(t)))
    rows += [(9000 + i, t) for i, t in enumerate([None, "", " \t", "one", "ONE", "one two"])]
    rows += [(9500 + i, words(7, 60) + " " + words(2000 + i, 5)) for i in range(60)]  # a common passage
    sets = {}
    for d, t in rows:
        w = brute.WORD.findall(brute.lower_ascii(t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in simhash.alike_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: find(d) for d in sets}


def test_large_buckets_link_what_small_ones_do(spark, monkeypatch):
    rng = random.Random(77)
    base = rng.getrandbits(63)
    prints = {base ^ sum(1 << b for b in rng.sample(range(16), rng.randint(0, 6))) for _ in range(900)} | {rng.getrandbits(63) for _ in range(50)}
    rows = [(0, f, i % 3 == 2, f) for i, f in enumerate(sorted(prints))]
    rows.sort(key=lambda r: r[2])
    columns = [np.array(c) for c in zip(*rows, strict=True)]
    bucket, fp, probe, node = columns[0], columns[1].astype(np.uint64), columns[2].astype(bool), columns[3].astype(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(fp.view(np.int64)), pa.array(probe), pa.array(node)], names=["bucket", "fp", "probe", "node"])

    def groups(large):
        monkeypatch.setattr(simhash, "_LARGE", large)
        root = {int(f): int(f) for f in node}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for out in simhash._bucket_links(3, False)(iter([batch])):
            for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
        return {f: find(f) for f in root}

    assert groups(10**6) == groups(8)


def test_fingerprints_of_long_texts_are_counted_in_runs(spark, monkeypatch):
    rows = [(i, words(i, n)) for i, n in enumerate([1, 3, 700, 5000, 40, 2500])]
    monkeypatch.setattr(simhash, "_RUN", 333)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["doc_id", "text"])
    (out,) = simhash._fingerprinter(4, 42)(iter([batch]))
    assert [f & (2**64 - 1) for f in out.column(1).to_pylist()] == [brute.fingerprint(t) for _, t in rows]


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components_close_long_chains(spark, one_task):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(chain, one_task).collect()}
    assert simhash.components(chain.limit(0), one_task).count() == 0
    assert len(got) == 203 and {got[i] for i in range(201)} == {0} and got[1001] == 1000


# ---- substring dedup -------------------------------------------------------------------------


def test_substring_dedup(spark, awkward, clashing, none):
    for df in (awkward, clashing):
        got = substring_dedup.remove_repeats(df)
        assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
        assert order(map(tuple, got.collect())) == order(brute.remove_repeats(rows_of(awkward)))
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substring_dedup_of_texts_that_share_an_id(spark):
    p, q, r = (words(s, 60) for s in (1, 2, 3))
    rows = [(1, p), (2, p), (2, q), (None, r), (None, p)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert order((r.doc_id, r.n_removed) for r in got) == order([(1, 0), (2, 60), (2, 0), (None, 0), (None, 60)])
    rows += [(2, q + " " + p), (3, q), (3, r), (3, words(1, 200)), (4, r)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (4096, 1):
        assert order(map(tuple, substring_dedup.remove_repeats(df, group_regions=size).collect())) == order(brute.remove_repeats(rows))


@pytest.mark.parametrize("group_regions", [512, 40, 3, 1])
def test_substring_dedup_of_shared_passages(spark, group_regions):
    rng = random.Random(12)
    shared = [words(100 + i, rng.randint(49, 130)) for i in range(6)]
    rows = []
    for d in range(60):
        parts = [words(1000 + 7 * d + j, rng.randint(0, 60)) for j in range(3)]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(shared[:2] if d % 2 else shared))
        rows.append((d, " ".join(p for p in parts if p)))
    rows += [(100 + i, rows[i][1]) for i in range(8)] + [(200, " ".join(["x"] * 300)), (201, " ".join(["x"] * 120)), (202, "x y " * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.remove_repeats(df, group_regions=group_regions)
    assert order(map(tuple, got.collect())) == order(brute.remove_repeats(rows))


def test_repeated_offsets_by_hand():
    common = [f"c{i}" for i in range(60)]
    a, b = ["p", "q", *common, "r"], ["z", *common, "s", "t"]
    found = substring_dedup.repeated_offsets([a, b], [2 + 5, 1 + 5], [1, 2], 50, 8)
    assert found[0] is None and found[1] == (0, 5)


# ---- top-k -----------------------------------------------------------------------------------


def plain_topk(rows, asked, k):
    out = []
    for q, v in asked:
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), c) for c, w in rows if c != q and len(w) == len(v))
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("tile_rows", [2, 7, 2048])
def test_topk(spark, tile_rows):
    rng = random.Random(tile_rows)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(40)] + [(100, [1.0, 2.0]), (150, [0.0, 5.0]), (7, [9.0, 9.0, 9.0, 9.0])]
    bad = [(200, None), (250, [1.0, None, 0.0, 0.0]), (300, [float("nan"), 0.0, 0.0, 0.0]), (350, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows + bad, "vec_id long, vector array<double>").withColumn("score", F.lit("x"))
    got = topk.exact_topk(df, df.where("vec_id % 10 = 0"), tile_rows=tile_rows, query_rows=3, group_tiles=2, group_query_tiles=2)
    asked = [r for r in rows if r[0] % 10 == 0]
    assert sorted(map(tuple, got.collect())) == sorted(plain_topk(rows, asked, 5))
    assert topk.exact_topk(df.limit(0), df.limit(0)).count() == 0


# ---- packing ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.public_tokenizer("byte_bpe_50k.json"))


def check_places(got, most):
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= most
    return len(bins)


def test_packing(spark, awkward, clashing, none, tokenizer):
    path = queries.public_tokenizer("byte_bpe_50k.json")
    for df in (awkward, clashing):
        got = packing.pack_documents(df, path, most=256).collect()
        pieces = defaultdict(list)
        for r in got:
            pieces[(r.doc_id, r.piece)].append((r.start, r.length, r.ids_crc32))
        assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in brute.pieces(rows_of(awkward), tokenizer, 256).items()}
        assert check_places(got, 256) <= -(-sum(r.length for r in got) // 256) + 1
    assert packing.pack_documents(none, path).count() == 0
    whole = packing.sequences(packing.pack_documents(awkward, path, most=256, with_ids=True)).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in got)


def test_token_ids_of_odd_white_space(tokenizer):
    ids = packing.TokenIds(queries.public_tokenizer("byte_bpe_50k.json"))
    odd = ["a  b", "a \n b", " lead", "x\n\ny", "tab\tz q", "", "\n", " ", "a  b", "don't it's", "1,234.5 x²", "İstanbul ſ ß", "日本 語", "q\r\nz w", "end ", "é. è, ñ!", "ab.\ncd", "<|endoftext|> x", "a\x1c b", "a　b  c"]
    rng = random.Random(8)
    odd += ["".join(rng.choice("ab .,\n\té1'") for _ in range(40)) for _ in range(400)]
    odd += ["".join(rng.choice(["<|endoftext|>", "<|endof", "text|>", " ", "a", "\n", ". "]) for _ in range(12)) for _ in range(200)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in odd]
    import numpy as np

    assert [np.frombuffer(b, "<u4").tolist() for b in ids(odd)] == want
    assert [np.frombuffer(b, "<u4").tolist() for b in ids(odd)] == want
    assert any(50256 in x for x in want)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.public_tokenizer("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    as_text = packing.TokenIds(queries.public_tokenizer("byte_bpe_50k.json"), special_as_text=True)
    assert [np.frombuffer(b, "<u4").tolist() for b in as_text(odd)] == [plain.encode(t, add_special_tokens=False).ids for t in odd]


def test_local_search_empties_bins():
    lengths = [6, 5, 4, 5]  # a swap of 5 for 4 makes room for a move
    out = packing.improve([[0], [1, 2], [3]], lengths, 10)
    assert len(out) == 2 and sorted(i for b in out for i in b) == list(range(4))
    assert all(sum(lengths[i] for i in b) <= 10 for b in out)
    rng = random.Random(2)
    many = [rng.randint(1, 900) for _ in range(3000)]
    packed = packing.improve(packing.best_fit(many, 2048), many, 2048)
    assert sorted(i for b in packed for i in b) == list(range(3000)) and len(packed) <= -(-sum(many) // 2048) + 1


def test_local_search_ends_on_hard_sizes():
    rng = random.Random(4)
    for low, high in ((26, 50), (34, 51), (10, 60), (1, 3)):
        lengths = [rng.randint(low, high) for _ in range(300)]
        first = packing.best_fit(lengths, 100)
        most = len(first)
        bins = packing.improve(first, lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(300)) and max(sum(lengths[i] for i in b) for b in bins) <= 100
        assert -(-sum(lengths) // 100) <= len(bins) <= most
        fill = [sum(lengths[i] for i in b) for b in bins]
        if len(bins) == -(-sum(lengths) // 100):
            continue
        for own, a in zip(bins, fill, strict=True):
            gives = [lengths[i] for i in own] + [lengths[i] + lengths[j] for x, i in enumerate(own) for j in own[x + 1 :]]
            for other, b in zip(bins, fill, strict=True):
                if a < b:
                    assert not any(0 < n - t <= 100 - b for n in gives for t in [0, *(lengths[i] for i in other)])
    assert packing.improve([], [], 100) == []


# ---- language, toxicity, personal data -------------------------------------------------------


def test_language(spark, awkward, clashing, none):
    docs = _shared.table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(docs).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    for df in (awkward, clashing):
        out = {(r.doc_id, r.held_out): r for r in langid.identify(df).collect()}
        assert len(langid.identify(df).collect()) == df.count()
        by = {d: r for (d, _), r in out.items()}
        assert [by[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in out.values())
        assert by[1].lang_pred != "und" and by[None].held_out
    assert langid.identify(none).count() == 0
    unlabelled = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_gram_counts_of_long_texts(monkeypatch):
    text = words(5, 300).replace("w", "wé")
    whole = dict(zip(*(x.tolist() for x in langid.gram_counts(text)), strict=True))
    monkeypatch.setattr(langid, "_RUN", 17)
    parts = dict(zip(*(x.tolist() for x in langid.gram_counts(text)), strict=True))
    assert parts == whole


def test_toxicity(spark, awkward, clashing, none):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        t = words(i, rng.randint(5, 60)).split()
        if bad:
            t.insert(rng.randint(0, len(t)), rng.choice(["dreadfulness", "horrid", "vile"]))
        rows.append((i, " ".join(f"x{w}y" if rng.random() < 0.1 else w for w in t), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, marks).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    odd = marks.unionByName(spark.createDataFrame([(None, 1, 1), (1, 1, None), (2, 1, 7), (1, None, 0)], marks.schema))
    for df in (awkward, clashing):
        assert toxicity.score_toxicity(df, odd).count() == df.count()
        assert toxicity.drop_toxic(df, odd).columns == df.columns
    assert toxicity.score_toxicity(none, marks).count() == 0
    assert {r.predicted for r in toxicity.score_toxicity(awkward, marks.limit(0)).collect()} == {0}


def plain_spans(text):
    """All candidates against all spans taken, in order of likelihood, length and place."""
    every, scored = pii.base_spans(text), []
    taken = [s for v in every.values() for s in v]
    for kind, a, b in pii.candidates(text):
        trees, least = pii.model()[kind]
        if not any(a < e and s < b for s, e in taken) and (p := trees.probability(pii.features(text, kind, a, b))) >= least:
            scored.append((-p, a - b, a, b, kind))
    for _, _, a, b, kind in sorted(scored):
        if not any(a < e and s < b for s, e in taken):
            taken.append((a, b))
            every[kind] = sorted([*every[kind], (a, b)])
    return every


def test_all_personal_spans_equal_a_plain_choice(spark):
    rng = random.Random(12)
    pieces = ["mail bob (at) site.org ", "tel 017 555 7713 ", "call 0049 30 1234567, ", "card 4111111111111111 ", "4111 1111 1111 1111-", "+1 (234) 555-0199 ", "10.0.0.1 ", "host 1.2.3.4.5 ", "order 123456789 ", "a@b.c@d.e ", "word "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 20))) for _ in range(150)]
    want = {i: pii._joined(plain_spans(t)) for i, t in enumerate(texts)}
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.spans for r in got} == want
    assert any(len(w) > len(pii._joined(pii.base_spans(t))) for t, w in zip(texts, want.values(), strict=True))


def test_personal_data(spark, awkward, clashing, none):
    import re

    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = random.Random(6)
    pieces = ["a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111111", "+1 (234) 555-0199", "+12 34", "é", "日本", " ", "-", ".", "12", "007.08.09.010", "+", "(", "a@b.c@d.e"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(800)]
    for t in texts:
        base, every = pii.find(t)
        for kind, p in plain.items():
            want = []
            for m in re.finditer(p, t):
                d = re.sub(r"[^0-9]", "", m.group())
                ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False, "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
                if ok:
                    want.append(m.span())
            assert base[kind] == want
            assert set(want) <= set(every[kind])
    assert pii.find("call +1 (017) 555-7713 4111111111111111 now")[1]["card"] == [(23, 39)]
    assert pii.redact("mail a.b@c.de, no 12") == "mail <email>, no 12" and pii.redact(None) is None
    assert pii.find(words(3, 300))[1] == {k: [] for k in pii.KINDS}
    for df in (awkward, clashing):
        assert pii.find_pii(df).count() == df.count()
        assert pii.redacted(df).columns == df.columns
    assert pii.find_pii(none).count() == 0


def test_personal_data_in_very_long_runs():
    text = "9" * 300_000 + " " + "a" * 300_000 + "@" + "." * 10 + "+" + "(" * 100_000
    assert all(not v for v in pii.find(text)[0].values())


# ---- queries and pipeline --------------------------------------------------------------------


def test_queries_return_every_row(spark):
    docs = _shared.table(spark, SF, "documents").count()
    pages = _shared.table(spark, SF, "pages").count()
    q = queries.queries()
    assert q["op2_warc"](spark, SF).count() == pages
    for name in ("op1_langid", "op3_mixing", "op5_pii", "op10_exact_dedup"):
        assert q[name](spark, SF).count() == docs
    assert set(queries.oracle_sql()) <= set(q) and {n.split("_")[0] for n in q} == {f"op{i}" for i in range(1, 11)}


def test_pipeline(spark, tokenizer):
    import corpus_pipeline as p

    docs = _shared.table(spark, SF, "documents")
    before, kept = docs, {}
    for name, stage in p.STAGES[:-1]:
        after = _shared.written(stage(spark, before, SF), name)
        assert after.columns == docs.columns
        kept[name], before = rows_of(after), after
    labels = {r.doc_id: r.toxic for r in _shared.table(spark, SF, "labels").collect()}
    dropped = {d for d, _ in rows_of(docs)} - {d for d, _ in kept["toxicity"]}
    assert sum(labels.get(d, 1) for d in dropped) >= 0.5 * len(dropped)
    best = {}
    for d, t in kept["toxicity"]:
        best[t] = max(d, best.get(t, d))
    assert sorted(kept["exact_dedup"]) == sorted((d, t) for t, d in best.items())
    comp = simhash.alike_groups(spark.createDataFrame(kept["exact_dedup"], "doc_id long, text string")).collect()
    assert {d for d, _ in kept["simhash_near_dedup"]} == {r.component_id for r in comp}
    assert set(kept["mixing"]) <= set(kept["simhash_near_dedup"]) and max(Counter(kept["mixing"]).values()) <= 3
    got = p.STAGES[-1][1](spark, before, SF).collect()
    assert check_places(got, 2048) <= -(-sum(r.length for r in got) // 2048) + 1
    want = brute.pieces(kept["mixing"], tokenizer)
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in got) == Counter((*k, x[2]) for k, v in want.items() for x in v)
    assert p.run(spark, SF).count() == len(got)


def test_toxicity_odds_do_not_depend_on_the_sample(spark):
    docs = spark.createDataFrame([(i, "the very same words") for i in range(1100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i in range(1100)], "doc_id long, toxic int")
    whole, few = (toxicity._trained(docs, labels, 5, most, {}).score("the very same words") for most in (4000, 40))
    assert abs(whole - 1 / 11) < 0.03 and abs(few - whole) < 0.03  # 80 rows of 40 each gave 0.5


def test_spelt_addresses_are_proposed_next_to_others():
    text = "write to ann@example.com or bob AT host DOT org"
    assert ("email", text.index("bob"), len(text)) in pii.candidates(text)


def plain_grams(text):
    """Letters in lower case, one blank for all else between, as strings of 4 and 5."""
    s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    s = " " + " ".join(s.split()) + " " if s.split() else " "
    return {s[k : k + n] for n in (4, 5) for k in range(len(s) - n + 1)}


def test_toxicity_equals_a_plain_version(spark):
    rng = random.Random(11)
    rows = []
    for i in range(160):
        t = [rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + ("ly" if rng.random() < 0.3 else "") for _ in range(rng.randint(0, 12))]
        rows.append((i, " ".join(t + (["vile", "Horrid!"] if i % 3 == 0 and rng.random() < 0.9 else [])), "en", "s", 1))
    labels = [(i, 1, int(i % 3 == 0)) for i in range(160)]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    grams = {i: plain_grams(t) for i, t, *_ in rows}
    train = [i for i in range(160) if zlib.crc32(str(i).encode()) % 5]
    y = np.array([float(i % 3 == 0) for i in train])
    seen = Counter(g for i in train for g in grams[i])
    features = sorted(g for g, n in seen.items() if n >= 3)  # fewer than the operator keeps
    assert len(features) < 4096
    x = np.array([[float(g in grams[i]) for g in features] for i in range(160)])
    own = x[train]
    ratio = np.log(((own[y == 1].sum(0) + 1) / (y.sum() + 2)) / ((own[y == 0].sum(0) + 1) / ((1 - y).sum() + 2)))
    z = own * ratio
    w, m, v = (np.zeros(len(features) + 1) for _ in range(3))
    w[-1] = np.log((y.sum() + 1) / ((1 - y).sum() + 1))
    for t in range(1, 151):
        error = 1 / (1 + np.exp(-(z @ w[:-1] + w[-1]))) - y
        grad = np.append(z.T @ error / len(y) + 1e-4 * w[:-1], error.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    want = 1 / (1 + np.exp(-((x * ratio) @ w[:-1] + w[-1])))
    assert all(got[i] == pytest.approx(want[i], abs=0.02) for i in range(160))  # buckets may hold two n-grams


def test_toxicity_sample_has_one_text_an_id(spark):
    rows = [(i, "vile words" if i % 2 else "kind words", "en", "s", 1) for i in range(40)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    once = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(rows, DOCS), labels).collect()}
    many = toxicity.score_toxicity(spark.createDataFrame(rows + [rows[1]] * 300, DOCS), labels).collect()
    assert len(many) == 340 and all(r.score == pytest.approx(once[r.doc_id]) for r in many)


def plain_profile(texts):
    """N-grams of 1 to 3 characters by (count descending, code points from the last)."""
    count = Counter()
    for text in texts:
        s = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        s = s if s.strip() else " "
        for k in range(len(s)):
            count.update([g for g in (s[k], s[k : k + 2]) if g != " " and len(s) >= k + len(g)][: 2 if k + 1 < len(s) else 1])
            if k + 2 < len(s) and s[k + 1] != " ":
                count[s[k : k + 3]] += 1
    number = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(g))
    return sorted(count, key=lambda g: (-count[g], number(g)))[:300]


def test_language_equals_a_plain_version(spark):
    rng = random.Random(12)
    vocabulary = {"aa": "the quick brown foxes jump over lazy dogs".split(), "bb": "der schnelle braune fuchs springt über faule hunde".split(), "cc": "le renard brun saute par-dessus un chien".split()}
    rows = [(i, " ".join(rng.choices(vocabulary[lang], k=rng.randint(1, 30))), lang, "s", 1) for i in range(90) for lang in [rng.choice(sorted(vocabulary))]]
    rows += [(90, None, "aa", "s", 1), (91, "12 -- 3", "aa", "s", 1), (92, "fuchs dogs", None, "s", 1)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, DOCS)).collect()}
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    profiles = {lang: plain_profile([t for i, t, own, *_ in rows if own == lang and t is not None and i not in held]) for lang in vocabulary}
    for i, text, *_ in rows:
        assert got[i].held_out == (i in held)
        if not any(c.isalpha() for c in text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        top = plain_profile([text])
        apart = {lang: sum(abs(p.index(g) - k) if g in p else 300 for k, g in enumerate(top)) for lang, p in profiles.items()}
        best = min(sorted(apart), key=apart.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(1 - apart[best] / (300 * len(top)))
