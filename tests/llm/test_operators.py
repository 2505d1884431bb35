"""Each operator against a brute-force version, on awkward rows and on an empty table."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pathloom.llm import jaccard, linededup, lm, media, mixing, packing, quality, sharding, tokens, urls
from pathloom.llm.encode import Encoder
from pathloom.llm.words import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components(items, width, num, den):
    """(smallest id of the component of each item)."""
    sets = [shingles(t, width) for _, t in items]
    of = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * common >= num * len(sets[i] | sets[j]):
                a, b = of[i], of[j]
                of = [a if x == b else x for x in of]
    least = defaultdict(list)
    for k, (own, _) in zip(of, items):
        if own is not None:
            least[k].append(own)
    return [min(least[k]) if sets[i] and least[k] else items[i][0] for i, k in enumerate(of)], [len(s) for s in sets]


@pytest.mark.parametrize("width,num,den", [(3, 90, 100), (5, 80, 100), (2, 50, 100)])
def test_jaccard_components(awkward, width, num, den):
    items = [(r.doc_id, r.text) for r in awkward.collect()]
    want, sizes = components(items, width, num, den)
    got = jaccard.similar_documents(awkward, width, num, den).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(((i, n, c) for (i, _), n, c in zip(items, sizes, want)), key=key)


def test_jaccard_near_copies_in_long_lists(spark, monkeypatch):
    """Many near copies whose links chain, in lists dealt as pairs of blocks."""
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 16)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(60)]
    items = []
    for i in range(90):
        text = list(base)
        for k in rng.choice(60, rng.integers(0, 4), replace=False):
            text[k] = f"v{rng.integers(40)}"
        items.append((i, " ".join(text)))
    got = jaccard.similar_documents(spark.createDataFrame(items, "doc_id long, text string"), 3, 90, 100).collect()
    want, _ = components(items, 3, 90, 100)
    assert [r.component_id for r in sorted(got)] == want


def test_shingle_sets_match_texts():
    texts = ["a b c a b c", "A B  c\ta b c", "a", "", None, "a b", "b a", "a b c d"]
    got, ptr = shingle_sets(pa.array(texts), 3)
    sets = [set(got[a:b].tolist()) for a, b in zip(ptr[:-1], ptr[1:])]
    assert [len(s) for s in sets] == [len(shingles(t, 3)) for t in texts]
    assert sets[0] == sets[1] and sets[5] != sets[6] and len(sets[0] & sets[7]) == 1


def test_line_dedup(awkward):
    data = awkward.collect()
    low = -(1 << 63)
    norm = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOWER)
    docs = defaultdict(set)
    for r in data:
        for line in (r.text or "").split("\n"):
            if len(norm(line)) >= 40:
                docs[norm(line)].add(low if r.doc_id is None else r.doc_id)
    often = {k: max(v) for k, v in docs.items() if len(v) >= 5}
    assert often
    want = []
    for r in data:
        lines = (r.text or "").split("\n")
        left = [x for x in lines if norm(x) not in often or often[norm(x)] == (low if r.doc_id is None else r.doc_id)]
        want.append((str(r.doc_id), None if r.text is None else "\n".join(left), len(lines), len(lines) - len(left)))
    got = [(str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in linededup.dedup_lines(awkward).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_bloom_has_what_was_added():
    h = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    b = linededup.Bloom.of_size(2500)
    b.add(h[:2500])
    assert b.has(h[:2500]).all() and b.has(h[2500:]).mean() < 0.02


def repeat_words(w):
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(inside)


@pytest.mark.parametrize("share", [None, 0.1])
def test_quality_rules(awkward, share):
    data = awkward.collect()
    norm = lambda line: line.strip(" \t\n\x0b\f\r").lower()
    hosts, docs = Counter(r.source for r in data), Counter()
    for r in data:
        docs.update({(r.source, norm(x)) for x in (r.text or "").split("\n") if norm(x)})
    often = {k for k, n in docs.items() if n > 3 and (share is None or n > share * hosts[k[0]])}
    assert often
    want = []
    for r in data:
        w = WORD.findall(r.text or "")
        lines = [x for x in (r.text or "").split("\n") if norm(x)]
        failed = len(w) < 10 or 100 * repeat_words(w) > 20 * len(w)
        lost = sum(len(WORD.findall(x)) for x in lines if (r.source, norm(x)) in often)
        clean = None if r.text is None else "\n".join(x for x in r.text.split("\n") if (r.source, norm(x)) not in often)
        symbols = sum(c in "#*$%&|<>" for c in r.text or "")
        want.append((str(r.doc_id), len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), repeat_words(w), failed, not failed and len(w) - lost >= 0.3 * len(w), clean))
    got = [(str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.clean_text) for r in quality.quality_rules(awkward, min_docs=3, max_share=share).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_mix_targets_and_order(awkward):
    got = mixing.mix(awkward).collect()
    size = {r.source: 0 for r in got}
    taken = dict.fromkeys(size, 0)
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.size * r.copies
        assert r.size == len(WORD.findall(r.text or "")) and r.copies in (0, 1, 2)
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(size.values()), set(order), {}
    while over := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]]:
        for s in over:
            target[s] = 2 * size[s]
        open_ -= set(over)
        left = 1.5 * sum(size.values()) - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source])
    longest = max(r.size for r in got)
    assert all(abs(taken[s] - target[s]) <= longest / 2 for s in size)
    again = sorted((str(r.doc_id), r.copies) for r in mixing.mix(awkward.repartition(5)).collect())
    assert again == sorted((str(r.doc_id), r.copies) for r in got)


@pytest.mark.parametrize("shards", [1, 7, 40, 500])
def test_interleave(awkward, shards, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", 9)
    monkeypatch.setattr(sharding, "PLACES_PER_RANGE", 11)
    got = sharding.interleave(awkward, shards).select("doc_id", "source", "shard", "slot").collect()
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert len(got) == awkward.count() and all(sorted(v) == list(range(len(v))) for v in places.values())
    counts = [len(places[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    if shards == 7:  # every shard has its share of every source, one row more or less
        per = Counter((r.shard, r.source) for r in got)
        for s, n in Counter(r.source for r in got).items():
            assert all(abs(per[k, s] - n / 7) < 2 for k in range(7))


def test_url_cascade(spark):
    pages = [(1, "https://A.example.org/es/x"), (2, "http://a.b.org/q?x#y"), (3, None), (4, "no scheme"), (5, "http://x.com/de/1"), (6, "ftp://n.net"), (7, "http://n.net/?://z"), (8, "https://ok.net/p"), (8, "https://ok.net/p"), (9, "http://example.org/en/12"), (10, "http://notexample.org/es/")]
    df = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS key", "'z' AS listed")
    hosts = spark.createDataFrame([(f"h{i}.net", i % 3 == 0) for i in range(3000)] + [("n.net", True), ("ok.net", False), ("", False)], "host string, listed boolean")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, hosts, urls.RULES).collect()}
    assert got == {
        (1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "a.b.org", "/q", "org/", "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"),
        (5, "x.com", "/de/1", "com/de/", "block"), (6, "n.net", "", None, "block"), (7, "n.net", "/", None, "block"), (8, "ok.net", "/p", None, "allow"),
        (9, "example.org", "/en/12", "example.org/en/1", "block"), (10, "notexample.org", "/es/", "org/", "allow"),
    }
    every = hosts.selectExpr("host AS url0", "concat('http://', host, '/') AS url", "listed")
    out = urls.filter_urls(every, hosts, []).select("listed", "verdict").collect()
    assert all((r.verdict == "block") == r.listed for r in out)


@pytest.mark.parametrize("kind", ["none", "sub", "up", "average", "paeth", "adaptive"])
def test_png_round_trip(kind):
    image = np.random.default_rng(2).integers(0, 256, (9, 64)).astype(np.uint8)
    data = media.encode_png(image, kind)
    assert (media.decode_png(data) == image).all()
    broken = bytearray(data)
    broken[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(broken))


def test_media_columns(awkward):
    stored = media.store_texts(awkward.select("doc_id", "text", "size", "source"))
    got = media.read_media(stored).join(awkward.select("doc_id", "text").distinct(), "doc_id").collect()
    for r in got:
        raw = (r.text or "").encode()
        assert r.payload == raw + bytes(-len(raw) % 64 if raw else 64) and r.n_bytes == len(raw) and len(r.feature) == 16
    near = media.cosine_hash(np.arange(6400).reshape(100, 64) // 40)
    assert near == media.cosine_hash(np.arange(6400).reshape(100, 64) // 40 + 0.001)


def kneser_ney(train, texts, order):
    """Dictionaries of counts, gram by gram."""
    marks = ["<s>"] * (order - 1)
    seqs = [[*marks, *words(t), "</s>"] for t in train]
    a = {order: Counter(tuple(s[i - order + 1 : i + 1]) for s in seqs for i in range(order - 1, len(s)))}
    for k in range(order - 1, 0, -1):
        a[k] = Counter(g[1:] for g in a[k + 1])
    total, follow = defaultdict(int), defaultdict(Counter)
    for k in a:
        for g, c in a[k].items():
            total[g[:-1]] += c
            follow[g[:-1]][min(c, 3)] += 1
    d = {k: [0.0, *lm.discounts([sum(v == x for v in a[k].values()) for x in (1, 2, 3, 4)])] for k in a}
    uni = Counter(w for s in seqs for w in s[order - 1 :])

    def p(w, h):
        k = len(h) + 1
        low = p(w, h[1:]) if h else 1 / (len(uni) + 1)
        if not total[h]:
            return low
        c = a[k][(*h, w)]
        return max(c - d[k][min(c, 3)], 0) / total[h] + sum(d[k][x] * follow[h][x] for x in (1, 2, 3)) / total[h] * low

    n = sum(uni.values())
    for h in list(total)[:9]:
        assert math.isclose(sum(p(w, h) for w in uni) + p("<unk>", h), 1)
    out = []
    for t in texts:
        s = [*marks, *words(t), "</s>"]
        own = s[order - 1 :]
        scores = (math.log10(p(s[i], tuple(s[i - order + 1 : i]))) for i in range(order - 1, len(s)))
        out.append((len(own), sum(uni[w] > 0 for w in own), n, sum(math.log10((uni[w] + 1) / (n + len(uni) + 1)) for w in own), sum(scores)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_kneser_ney(awkward, order, monkeypatch):
    data = awkward.collect()
    train = awkward.where("doc_id % 3 <> 1")
    model = lm.train(train, order=order)
    got = lm.score(awkward, model).collect()
    want = kneser_ney([r.text for r in data if r.doc_id is not None and r.doc_id % 3 != 1], [r.text for r in data], order)
    key = lambda x: (x[0], x[1], round(x[3], 6), round(x[4], 6))
    got = sorted(((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    for x, y in zip(got, sorted(want, key=key), strict=True):
        assert x[:3] == y[:3] and math.isclose(x[3], y[3], rel_tol=1e-9) and math.isclose(x[4], y[4], rel_tol=1e-9)
    assert set(awkward.columns) - {"text", "score"} <= set(lm.score(awkward, model).columns)


def test_untrained_model(awkward, empty):
    model = lm.train(empty)
    assert model.words == 0 and all(r.score == 0 and r.n_known == 0 for r in lm.score(awkward, model).collect())
    assert lm.score(empty, model).count() == 0


@pytest.mark.parametrize("name,mode", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaced")])
def test_encoder_is_exact(awkward, name, mode, monkeypatch):
    monkeypatch.setattr("pathloom.llm.encode.MOST_PIECES", 50)
    own = Encoder(path(name), mode)
    texts = [r.text for r in awkward.collect()] + ["a  b \n\n c", "\x1c x\x1d", "don't 'LL <|endoftext|> z<|endoftext|>", " ́ e ́", "ΑΣ ΑΣ. İ", "   a"]
    for part in (texts[:30], texts[30:], texts):
        ids, ptr = own.encode(pa.array(part))
        want = [e.ids for e in own.tokenizer.encode_batch([t or "" for t in part], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(ptr[:-1], ptr[1:])] == want


def test_a_word_is_encoded_once_in_any_case_and_between_any_marks():
    own = Encoder(path("word_bpe_49k.json"))
    texts = ["word Word, WORD! (word) word7", "été Été, ÉTÉ.", "don't DON'T. 's'S", "H̱ ẖ, Éẖ! É̱H", "K×k÷ß ªb. x—y,z", "7a7'll7 ''s !'s", "A<b>c|D"]
    for part in (texts, [*texts, "Z<|endoftext|>z, <|ENDOFTEXT|>"], texts[::-1]):
        ids, ptr = own.encode(pa.array(part))
        assert [ids[a:b].tolist() for a, b in zip(ptr[:-1], ptr[1:])] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in part]
    own = Encoder(path("word_bpe_49k.json"))
    own.encode(pa.array(texts[:2]))
    assert sorted(own.slot) == sorted(c.encode() for c in ["word", ",", "!", "(", ")", "7", "été", "."])


def test_a_spaced_word_is_encoded_once_between_any_marks():
    import random

    own, r = Encoder(path("byte_bpe_50k.json")), random.Random(5)
    some = [*"aBéÉÃ×70²½'!,(—字µª\x01😀", "'s", "'LL", "ll", "é", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b"]
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    for part in (texts[:1500], [*texts[1500:], "a, <|endoftext|>b  <|endoftext|>", "a  b!", None], ["a\x1c b", "c"]):
        ids, ptr = own.encode(pa.array(part))
        assert [ids[a:b].tolist() for a, b in zip(ptr[:-1], ptr[1:])] == [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]
    own = Encoder(path("byte_bpe_50k.json"))
    own.encode(pa.array([" word, word! word77\n word.77été\tété's", "  word\nété  "]))
    assert sorted(own.slot) == sorted(c.encode() for c in [" word", ",", "!", "77", "\n", ".", "été", "\t", "'s", " ", "  "])


def test_token_files(spark, awkward, tmp_path):
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(path("word_bpe_49k.json")), f"file://{tmp_path}/tokens"
    tokens.write_tokens(awkward, at, path("word_bpe_49k.json"), stride=1000)
    data = [(r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in awkward.collect()]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    start, want = 0, []
    for i, ids in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]), crc(x[1]))):
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    got = tokens.token_places(spark, at).orderBy("start").collect()
    assert [tuple(r) for r in got] == want
    found = tokens.read_tokens(spark, at, [3, 21]).collect()
    assert {(r.doc_id, tuple(r.ids)) for r in found} == {(i, tuple(x)) for i, x in data if i in (3, 21)}
    import glob

    import pyarrow.orc as orc

    files = glob.glob(f"{tmp_path}/tokens/*.orc")
    assert sum(orc.ORCFile(f).nrows for f in files) == len(data)
    assert sum(orc.ORCFile(f).read_stripe(k).num_rows for f in files for k in range(orc.ORCFile(f).nstripes)) == len(data)


def test_packing(awkward):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    got = packing.pack_documents(awkward, path("byte_bpe_50k.json"), room=256).collect()
    want = []
    for r in awkward.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)]
        want += [(str(r.doc_id), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(seqs) <= packing.lower_bound(np.array([r.length for r in got]), 256) + 1


def test_genetic_steps_keep_every_piece():
    import random

    rng, size = random.Random(1), np.random.default_rng(1).integers(1, 100, 300)
    a, b = packing.best_fit(size, 100), packing.best_fit(size, 100, rng)
    for _ in range(20):
        a, b = packing.crossover(a, b, size, 100, rng), packing.mutate(a, size, 100, rng)
        for x in (a, b):
            assert (x.bin_of >= 0).all() and (np.bincount(x.bin_of, size, len(x.left)) == 100 - x.left).all() and (x.left >= 0).all() and (x.left < 100).all()
    assert len(packing.evolve(size, 100, [], 3)[0].left) <= len(packing.best_fit(size, 100).left)


def test_lower_bound():
    assert packing.lower_bound(np.array([60, 60, 60]), 100) == 3
    assert packing.lower_bound(np.array([50, 50, 51]), 100) == 2
    assert packing.lower_bound(np.array([], int), 100) == 0


def test_empty_tables(spark, empty, tmp_path):
    assert jaccard.similar_documents(empty).count() == 0
    assert linededup.dedup_lines(empty).count() == 0
    assert quality.quality_rules(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert sharding.interleave(empty, 4).count() == 0
    assert media.read_media(media.store_texts(empty)).count() == 0
    assert packing.pack_documents(empty, path("byte_bpe_50k.json")).count() == 0
    tokens.write_tokens(empty, f"file://{tmp_path}/none", path("word_bpe_49k.json"))
    assert tokens.token_places(spark, f"file://{tmp_path}/none").count() == 0
    assert urls.filter_urls(spark.createDataFrame([], "url string"), spark.createDataFrame([], "host string, listed boolean"), urls.RULES).count() == 0


def test_extra_columns_stay(awkward):
    for out, new in ((linededup.dedup_lines(awkward), set()), (quality.quality_rules(awkward), set()), (mixing.mix(awkward), {"size", "target"}), (sharding.interleave(awkward, 4), {"shard"})):
        assert set(awkward.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
        assert out.select("lang", "source", "h", "node", "epochs", "last", "s", "id").distinct().where("h = 'clash'").count() > 0
    assert hashlib.sha256(b"").hexdigest()
