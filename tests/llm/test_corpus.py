"""Near-duplicates, tokens, packing, languages, suffix arrays and the pipeline on small fixtures, against plain Python."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from kitescope.llm import language_id, near_dedup, packing, repair_tokens, suffix_dedup, token_counts
from kitescope.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key int, rows int, part int"


def table_of(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3) for i, t in zip(ids, texts)], SCHEMA)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def shingles(text, width=3):
    w = (text or "").translate({i: i + 32 for i in range(65, 91)}).split()
    return {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def near_texts():
    rng = random.Random(4)
    base = prose(rng, 130)
    texts = [None, "", " ", "one", "One", "one two", base, base.upper(), base + " "]
    texts += [edited(rng, base, rng.randrange(1, 14)) for _ in range(40)]
    texts += [" ".join(f"b{i}" for i in range(n)) for n in range(7, 40)]
    texts += [" ".join(f"a{i}" for i in range(9)), " ".join(f"a{i}" for i in range(8)), " ".join(f"a{i}" for i in range(7))]
    texts += [prose(rng, 100) + " " + " ".join(f"shared{i}" for i in range(60)) for _ in range(8)]
    return texts + [prose(rng, rng.randrange(3, 300)) for _ in range(20)] + [" ".join(f"v{i}" for i in range(3000))] * 3


def components(texts, width, percent):
    sets = [shingles(t, width) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


@pytest.mark.parametrize("small,block,width,percent", [(16, 16 << 20, 3, 85), (1, 16 << 20, 5, 80), (2, 20_000, 3, 85)])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, small, block, width, percent):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    texts = near_texts()
    got = near_dedup.classes(table_of(spark, texts), width=width, percent=percent, block_bytes=block).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == components(texts, width, percent)


def test_one_document_of_each_group_stays(spark):
    texts = ["x y z w"] * 4 + ["p q r s t"] * 2 + [None, None]
    ids = [3, 1, 1, None, None, None, 7, 8]
    kept = near_dedup.keep_one(table_of(spark, texts, ids))
    assert kept.columns == table_of(spark, texts).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, "x y z w"), (None, "p q r s t"), (7, None), (8, None)], key=repr)
    empty = table_of(spark, texts).limit(0)
    assert near_dedup.keep_one(empty).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)]
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 130)}}


TOKEN_TEXTS = [None, "", "a", "Plain words, and more.\nNext line", "double  space \n x ", "it's l'été", "日本語 text", "<|endoftext|> # !", "word " * 5000 + "end", "é ü ñ z", "a", "a"]


def ids_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    "a.\n\nDe", "x\n\n\ny", "a\r\nb", "x\n b", "end ", "end\n", " start", "a \n b", "a1b2 c3", "x_y-z a.b,c", "\ta", "it's", "l'été", "a\x1c b", "ab\x85 c",
    "ªº µ", "Ωmega x", "日本 語", "a  b", "× ÷ a×b", "word.\nWord, word", "#a <|endoftext|> b"])
def test_pieces_give_the_ids_of_whole_texts(text):
    from kitescope.llm.tokens import Encoder

    encoder = Encoder(tokenizer_path())
    for texts in ([text], [f"one two {text} three", text, f"{text}\n{text}"]):
        assert list(encoder.encode(texts)) == [np.array(ids_of(x), "<u4").tobytes() for x in texts]


def test_packing(spark):
    docs = table_of(spark, TOKEN_TEXTS)
    rows = packing.pack_documents(docs, tokenizer_path(), capacity=64).collect()
    seen, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        seen[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for i, text in enumerate(TOKEN_TEXTS):
        ids, at = ids_of(text) + [0], 0
        for r in sorted(seen[i], key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and len(seen[i]) == -(-len(ids) // 64)
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0


def test_equal_pieces_are_dealt_to_many_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 20)
    rows = spark.createDataFrame([(None, 0, 0, 10, 7)] * 400, "doc_id long, piece int, start long, length long, ids_crc32 long")
    dealt, parts = packing._deal(rows, 400, 4000)
    sizes = [r["count"] for r in dealt.groupBy("part").count().collect()]
    assert parts == 20 and len(sizes) == 20 and max(sizes) < 60
    packed = packing.pack(rows, capacity=64).collect()
    bins = collections.Counter(r.sequence_id for r in packed)
    assert len(packed) == 400 and max(bins.values()) == 6


def test_local_search_saves_bins():
    rng = random.Random(3)
    lengths = [rng.randint(20, 60) for _ in range(300)]
    bins = packing.best_fit(lengths, 100)
    better = packing.improve([list(b) for b in bins], lengths, 100)
    assert sorted(i for b in better for i in b) == list(range(300))
    assert all(sum(lengths[i] for i in b) <= 100 for b in better) and len(better) < len(bins)


@pytest.mark.parametrize("n,least,most,capacity", [(1500, 500, 900, 2048), (400, 20, 60, 100), (900, 1, 300, 2048)])
def test_local_search_ends_when_no_step_helps(n, least, most, capacity):
    rng = random.Random(6)
    lengths = [rng.randint(least, most) for _ in range(n)]
    bins = packing.improve(packing.best_fit(lengths, capacity), lengths, capacity)
    assert sorted(i for b in bins for i in b) == list(range(n))
    bins = [[lengths[i] for i in b] for b in bins]
    if len(bins) == -(-sum(lengths) // capacity):
        return
    for donor in bins:
        given = {*donor, *(x + y for k, x in enumerate(donor) for y in donor[k + 1:])}
        for taker in bins:
            if taker is not donor and sum(donor) <= sum(taker) < capacity:
                room = capacity - sum(taker)
                assert not any(0 < g - back <= room for g in given for back in {0, *taker}), (donor, taker)


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_token_counts_across_blocks(spark, block):
    docs = table_of(spark, TOKEN_TEXTS).repartition(2)
    blocks, order = token_counts.write_tokens(docs, tokenizer_path(), block=block)
    got = token_counts.scan(blocks).join(order, ["file", "ordinal"]).collect()
    texts = dict(enumerate(TOKEN_TEXTS))
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(i, len(ids_of(t))) for i, t in texts.items()]


def test_token_scan_of_an_open_end(spark):
    rows = [(0, 0, np.array([5, 9], "<u2").tobytes()), (0, 1, np.array([7, 7], "<u2").tobytes()), (0, 2, np.array([9, 9], "<u2").tobytes()), (0, 3, np.array([4], "<u2").tobytes())]
    got = token_counts.scan(spark.createDataFrame(rows, "file long, block long, ids binary"), end_id=9).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 0, 1, True), (0, 1, 2, 2, True), (0, 2, 5, 0, True), (0, 3, 6, 1, False)]


def test_repair_round_trip_and_random_access(spark):
    docs = table_of(spark, TOKEN_TEXTS, [5, 4, 3, 3, 9, 8, 7, 6, 20, 21, 22, 22])
    got = repair_tokens.read(repair_tokens.write(docs, tokenizer_path(), block_ids=50)).collect()
    rows = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([5, 4, 3, 3, 9, 8, 7, 6, 20, 21, 22, 22])
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    crcs = [zlib.crc32(np.array(ids_of(t) + [2], "<u4").tobytes()) for t in TOKEN_TEXTS]
    assert sorted(r.ids_crc32 for r in rows) == sorted(crcs)
    assert repair_tokens.read(repair_tokens.write(docs.limit(0), tokenizer_path())).count() == 0
    blocks = repair_tokens.write(docs, tokenizer_path(), block_ids=50)
    whole = {r.doc_id: r.n_tokens for r in rows}
    texts = dict(zip([5, 4, 3, 3, 9, 8, 7, 6, 20, 21, 22, 22], TOKEN_TEXTS))
    asked = [(i, a, b) for i in (5, 4, 9, 8, 7, 6, 20, 21, 99) for a, b in ((0, 3), (None, None), (2, 2), (1, 10**6))]
    wanted = spark.createDataFrame(asked, "doc_id long, `from` long, `to` long")
    got = {(r.doc_id, r["from"], r["to"]): r.ids for r in repair_tokens.read_slices(blocks, wanted).collect()}
    assert got == {(i, a, b): (ids_of(texts[i]) + [2])[a:b] for i, a, b in asked if i in whole}


def frequent_pairs(seq, ends, least):
    seen, begin = collections.Counter(), 0
    for end in ends:
        part = seq[begin:end].tolist()
        seen.update(zip(part, part[1:]))
        begin = end
    return [p for p, n in seen.items() if n >= least]


def test_repair_leaves_no_frequent_pair():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, kinds, least = int(rng.integers(0, 300)), int(rng.integers(1, 6)), int(rng.integers(2, 6))
        ids = rng.integers(0, kinds, n).astype(np.uint32)
        stops = np.sort(rng.integers(0, n + 1, 4))
        stops[-1] = n
        base, rules, levels, seq, ends = repair_tokens.compress(ids, stops, least)
        assert repair_tokens.expand(seq, base, rules, levels).tolist() == ids.tolist()
        assert not frequent_pairs(seq, ends, least)
        lengths = repair_tokens.expansion_lengths(base, rules, levels)
        for a, b, x, y in zip([0, *ends], ends, [0, *stops], stops):
            assert repair_tokens.expand(seq[a:b], base, rules, levels).tolist() == ids[x:y].tolist()
            i, j = sorted(rng.integers(-2, n + 3, 2).tolist())
            assert repair_tokens.slice_of(seq[a:b], base, rules, lengths, i, j).tolist() == ids[x:y][max(i, 0):max(j, 0)].tolist()


def test_repair_shrinks_copies_to_one_symbol_each():
    rng = np.random.default_rng(2)
    ids = np.tile(rng.integers(0, 50_000, 220).astype(np.uint32), 500)
    _, rules, _, seq, _ = repair_tokens.compress(ids, np.arange(1, 501) * 220)
    assert len(seq) == 500 and len(rules) <= 219


def test_languages(spark):
    rng = random.Random(1)
    words = {"en": ["the", "thing", "with"], "de": ["der", "ungern", "über"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(30)), x) for i, x in enumerate(["en", "de"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs.filter("doc_id < 30"))
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(100, None), (101, ""), (102, "12 .")], "doc_id long, text string"))
    got = {r.doc_id: r for r in language_id.predict(more, model).collect()}
    assert all(got[i].lang_pred == x and 0 <= got[i].score <= 1 for i, _, x in rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (100, 101, 102))
    assert language_id.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in language_id.predict(more, None).collect()} == {"und"}


def plain_buckets(text):
    """Buckets of all 2- and 3-grams of a framed, lower-cased text, one gram at a time."""
    c, word = [ord(x) for x in f" {text.lower()} "], 2**32 - 1
    for n in (2, 3):
        for i in range(len(c) - n + 1):
            h = n
            for x, factor in zip(c[i:i + n], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
                h = ((h ^ (x * factor & word)) * 0x27D4EB2F) & word
                h ^= h >> 15
            yield h & 0xFFFF


def plain_bayes(learned, texts):
    """(language, posterior) of each text by naive Bayes with one added to every count."""
    counts, n = {}, collections.Counter(x for _, x in learned)
    for text, lang in learned:
        counts.setdefault(lang, collections.Counter()).update(plain_buckets(text))
    totals = {x: sum(c.values()) + 65536 for x, c in counts.items()}
    for text in texts:
        if not text or not any(map(str.isalpha, text)):
            yield "und", 0.0
            continue
        held = list(plain_buckets(text))
        logs = {x: math.log(n[x] / len(learned)) + sum(math.log((counts[x][b] + 1) / totals[x]) for b in held) for x in sorted(counts)}
        best = max(logs, key=logs.get)
        yield best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())


def test_languages_equal_plain_bayes_on_mixed_texts(spark, monkeypatch):
    rng = random.Random(8)
    letters = {"aa": "abcde ", "bb": "cdefg ", "cc": "éüdxyz ", "dd": "漢字仮名ab"}
    def text(x):
        return "".join(rng.choice(letters[x]) for _ in range(rng.choice([0, 1, 3, 12, 200])))

    learned = [(text(x), x) for x in list(letters) * 15]
    asked = [text(rng.choice(list(letters))) + text(rng.choice(list(letters))) for _ in range(120)] + [None, "", " ", "1 2", "İ", "a"]
    model = language_id.fit(spark.createDataFrame(learned + [(None, "aa"), ("abc", None)], "text string, lang string"))
    rows = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(rows, model).collect()}
    want = list(plain_bayes(learned, asked))
    assert [got[i][0] for i in range(len(asked))] == [x for x, _ in want]
    assert [got[i][1] for i in range(len(asked))] == pytest.approx([p for _, p in want], abs=1e-9)
    monkeypatch.setattr(language_id, "_PIECE", 50)
    whole = [t for t in asked if t]
    pieces = [pair for part in language_id.grams(whole) for pair in zip(*map(list, part))]
    assert sorted(pieces) == sorted((b, i) for i, t in enumerate(whole) for b in plain_buckets(t))


def test_suffix_array_equals_sorting():
    rng = random.Random(5)
    for _ in range(80):
        k, n = rng.choice([1, 2, 3, 250]), rng.randint(1, 200)
        t = np.array([rng.randrange(k) for _ in range(n)], dtype=np.uint8)
        assert suffix_dedup.suffix_array(t, 10**6).tolist() == sorted(range(n), key=lambda i: t.tobytes()[i:])


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats_equal_a_set_of_strings(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "_PIECE", 700)
    rng = random.Random(2)
    base = [prose(rng, 120) for _ in range(4)]
    texts = [None, "", "short"] + base + [base[0]] * 3 + ["é" * 200, "é" * 150, base[1] + base[2] + base[1]]
    texts += [prose(rng, 10) + b[rng.randrange(100):rng.randrange(150, 400)] + prose(rng, 10) for b in base * 5]
    seen, expected = set(), []
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k:k + 100] in seen:
                gone[k:k + 100] = True
            seen.add(b[k:k + 100])
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        expected.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    docs = table_of(spark, texts)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect())) == expected
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_pipeline_stages_follow_their_rules(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    clean = [prose(rng, 150) for _ in range(6)]
    bench = prose(rng, 40)
    texts = clean + [clean[0], edited(rng, clean[1], 1), "two words", "### $$$ " * 30, clean[2] + " " + bench, clean[3] + " x " + prose(rng, 90) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.schema == docs.schema, name
    rows = {r.doc_id: r for r in kept.collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4, 5, 11]
    assert all(rows[i].text == texts[i] for i in range(6)) and "[secret]" in rows[11].text and rows[11].n_chars == len(rows[11].text)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in packed}) == sorted(rows)
    assert all(sum(r.length for r in packed if r.doc_id == i) == len(ids_of(rows[i].text)) + 1 for i in rows)
