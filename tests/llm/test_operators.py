"""The training-data operators against brute force, on small tables with every odd case."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.llm import chat, decontaminate, langid, licences, neardup, packing, quality, sharding, tokenids, warc
from strandframe.llm.common import WordCachedEncoder, fresh_path

public = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, label string, key long, host string, block long"
EMPTY = ("", None, " \n\t ", "a", "One two three", "ß É ñ 你好 x", "****")


def words(rng, n, alphabet="abcdefg"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = [words(rng, 60) for _ in range(12)]
    texts = list(EMPTY) + base + base[:3] * 3
    for t in base[:6]:  # near copies
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts.append(words(rng, 6000))
    texts.append("Line one is here\n" * 5 + "Other line follows now\n" + words(rng, 30))
    out = [(i, t, ["en", "de", None][i % 3], ["s0", None, "s1"][i % 3], None, "x", "y", i, "h", 1) for i, t in enumerate(texts)]
    return [*out, out[8], (None, "a text without an id but with some words in it", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(docs, rows, none):
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets.setdefault(r[0], brute_shingles(r[1]))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert neardup.near_duplicates(none).collect() == []
    left = neardup.deduplicated(docs)
    assert left.columns == docs.columns
    want = [i for i in sets if find(i) == i and sets[i]] + [r[0] for r in rows if r[0] is not None and not sets[r[0]]]
    assert sorted(r.doc_id for r in left.where("doc_id IS NOT NULL").collect()) == sorted(want)
    assert left.where("doc_id IS NULL").count() == 1 and neardup.deduplicated(none).collect() == []


def test_dedup_tells_rows_of_one_id_apart(spark):
    rng = random.Random(21)
    one, two, three = (words(rng, 50) for _ in range(3))
    near = " ".join(["other", *two.split()[1:]])
    data = [(5, one, "x"), (5, two, "y"), (5, two, "y"), (7, near, "z"), (None, one, "a"), (None, three, "c"), (None, three, "b"), (None, None, "n"), (8, "", "e"), (8, "", "e"), (3, three, "t")]
    d = spark.createDataFrame(data, ["doc_id", "text", "a.b"]).repartition(3)
    got = sorted((str(r.doc_id), r.text or "", r["a.b"]) for r in neardup.deduplicated(d).collect())
    assert got == sorted([("5", one, "x"), ("5", two, "y"), ("None", "", "n"), ("8", "", "e"), ("8", "", "e"), ("3", three, "t")])
    lone = d.where("doc_id IS NULL AND text IS NOT NULL")
    assert sorted((r.text, r["a.b"]) for r in neardup.deduplicated(lone).collect()) == sorted([(one, "a"), (three, "b")])
    ids = {(r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(d).where("doc_id = 7").collect()}
    assert ids == {(46, 5, False)}


def test_words_of_equal_sums_are_told_apart():
    def thue(n):
        return "".join("ab"[bin(i).count("1") & 1] for i in range(n))

    a = thue(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    assert neardup.word_hashes(a)[0] != neardup.word_hashes(b)[0]
    assert (neardup.word_hashes("Ab cd\tab  CD") == neardup.word_hashes("ab cd AB cd")).all()
    assert len(neardup.word_hashes("ab ba")) == 2 and neardup.word_hashes("ab ba")[0] != neardup.word_hashes("ab ba")[1]


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(22)
    text = words(rng, 3000) + " " + "x" * 5000 + "\n" + words(rng, 500)
    whole = neardup.word_hashes(text)
    for piece in (64, 1000, 4096):
        monkeypatch.setattr(neardup, "PIECE", piece)
        assert (neardup.word_hashes(text) == whole).all() and len(whole) == 3501


def test_pairs_at_the_limit_share_a_band_and_pass_the_sketches():
    """Bands and sketches lose no pair at or just over the similarity asked for."""
    rng = np.random.default_rng(5)
    lost = 0
    for size in (8, 20, 60, 200, 450):
        for _ in range(60):
            both = rng.integers(0, 1 << 63, size=size, dtype=np.uint64)
            extra = size * 25 // 75  # 100 * both >= 75 * union
            left, right = extra // 2, extra - extra // 2
            a = np.unique(neardup.mix(np.concatenate([both, rng.integers(0, 1 << 63, size=left, dtype=np.uint64)])))
            b = np.unique(neardup.mix(np.concatenate([both, rng.integers(0, 1 << 63, size=right, dtype=np.uint64)])))
            x, y = neardup.minhash(a), neardup.minhash(b)
            z = (int.from_bytes(neardup.odd_sketch(x), "big") ^ int.from_bytes(neardup.odd_sketch(y), "big")).bit_count()
            lost += not (neardup.band_keys(x) == neardup.band_keys(y)).any() or z > neardup.ODD_LIMIT
    assert lost == 0


def test_family_linked_by_others_only(spark, monkeypatch):
    """A bucket's smallest member may be linked to nobody while others are linked to one another."""
    rng = random.Random(3)
    base = words(rng, 200).split()

    def mutant(n):
        w = list(base)
        for k in rng.sample(range(len(w)), n):
            w[k] = "m%d" % rng.randrange(10**6)
        return " ".join(w)

    texts = [mutant(14)] + [mutant(rng.choice([2, 4, 6, 9, 12])) for _ in range(60)]
    sets = [brute_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: find(i) for i in range(len(texts))}
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(d).collect()} == want
    monkeypatch.setattr(neardup, "BLOCK", 4)  # more pivot rounds, and blocks of few members
    monkeypatch.setattr(neardup, "FAN", 3)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(d).collect()} == want
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(d).collect()} == want


def test_odd_sketch_estimates():
    a, b = set(range(1000)), set(range(100, 1100))
    h = lambda s: np.unique(neardup.mix(np.array(sorted(s), dtype=np.uint64)))
    x, y = (neardup.odd_sketch(neardup.minhash(h(s))) for s in (a, b))
    assert abs(neardup.odd_similarity(x, y) - 900 / 1100) < 0.12
    assert neardup.odd_similarity(x, x) == 1.0


def test_languages(spark, docs, none):
    rng = random.Random(1)
    rows = [(i, words(rng, 20, "abcde" if i % 2 else "vwxyz"), "aa" if i % 2 else "vv") for i in range(200)] + [(200, None, "aa"), (201, "123 !", None), (202, "", "vv")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(d, langid.train(langid.training_rows(d))).collect()}
    assert all(got[i].lang_pred == ("aa" if i % 2 else "vv") and 0 <= got[i].score <= 1 for i in range(200))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (200, 201, 202))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert langid.predict(none, langid.train(langid.training_rows(none))).collect() == []
    assert {r.lang_pred for r in langid.predict(docs, langid.train(langid.training_rows(none))).collect()} == {"und"}
    strange = spark.createDataFrame([(i, words(rng, 9, "abcde"), "aa", i) for i in range(9)] + [(9, None, "aa", 9), (10, "9 9", "vv", 10), (10, "vw wv", "vv", 10)], ["doc_id", "text", "lang", "a.b"])
    left = langid.accepted(strange, langid.train(langid.training_rows(d)))
    assert left.columns == strange.columns and sorted(r["a.b"] for r in left.collect()) == [*range(9), 10]
    assert langid.accepted(none, langid.train(langid.training_rows(d))).collect() == []
    with pytest.raises(ValueError, match="languages"):
        langid.train(spark.range(600).selectExpr("id doc_id", "'a b' text", "concat('l', id) lang"))


def brute_bayes(rows, texts):
    """Multinomial naive Bayes written for itself: dictionaries of n-grams, the same hash of them."""
    import math

    def grams(text):
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        padded = " " + " ".join(letters.split()) + " "
        out = []
        for n in (1, 2, 3, 4):
            for i in range(len(padded) - n + 1):
                h = 0
                for c in padded[i : i + n]:
                    h = (((h * 0x9E3779B97F4A7C15) & (2**64 - 1)) ^ (ord(c) + 1)) * 0xD6E8FEB86659FD93 & (2**64 - 1)
                out.append(h >> 49)
        return out

    counts, docs = {}, {}
    for text, lang in rows:
        docs[lang] = docs.get(lang, 0) + 1
        for g in grams(text) if any(c.isalpha() for c in text) else ():
            counts.setdefault(lang, {})[g] = counts.setdefault(lang, {}).get(g, 0) + 1
    total = sum(docs.values())
    found = []
    for text in texts:
        g = grams(text)
        score = {}
        for lang in sorted(docs):
            c = counts.get(lang, {})
            n = sum(c.values()) + 0.5 * (1 << 15)
            score[lang] = (sum(math.log((c.get(x, 0) + 0.5) / n) for x in g), math.log(docs[lang] / total))
        best = max(score, key=lambda k: score[k][0] + score[k][1])
        flat = {k: v * min(1, 200 / len(g)) + p for k, (v, p) in score.items()}
        top = max(flat.values())
        found.append((best, math.exp(flat[best] - top) / sum(math.exp(v - top) for v in flat.values())))
    return found


def test_languages_against_another_naive_bayes(spark):
    rng = random.Random(31)
    made = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "abcdijkl", "dd": "äöüabcïé"}
    train = [(words(rng, 30, letters), lang) for lang, letters in made.items() for _ in range(12 + len(lang) + ord(lang[0]) % 5)]
    d = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(train)], "doc_id long, text string, lang string")
    texts = [words(rng, n, rng.choice(list(made.values())) + extra) for n in (1, 2, 3, 8, 40, 300) for extra in ("", "xyz", "abcd") for _ in range(3)]
    model = langid.train(d)
    got, want = model.predict(texts), brute_bayes(train, texts)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert max(abs(g[1] - w[1]) for g, w in zip(got, want, strict=True)) < 1e-3
    assert [model.predict([t])[0] for t in texts] == got  # the same in any batch


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    p = langid.predict(docs, langid.train(langid.training_rows(docs))).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'")
    right, n = p.where("lang = lang_pred").count(), p.count()
    assert n > 1000 and right >= 0.99 * n


def test_long_texts_are_scored_whole(monkeypatch):
    rng = random.Random(2)
    texts = [words(rng, n) for n in (3, 2000, 1, 700, 50)]
    matrix = np.random.default_rng(1).integers(-(10**6), 0, size=(langid.BUCKETS, 3)).astype(np.int32)
    model = langid.Model(["a", "b", "c"], matrix, np.zeros(3))
    want = model.predict(texts)
    monkeypatch.setattr(langid, "PIECE", 97)
    assert model.predict(texts) == want
    c = langid.codes("some words of a text " * 30)
    whole = np.sort(langid.buckets(c))
    parts = np.sort(np.concatenate([langid.buckets_at(c, s, min(len(c), s + 50)) for s in range(0, len(c), 50)]))
    assert (whole == parts).all()


def test_warc(spark):
    rows = [(3, "http://a/b c\r\nx\ty\0z", "<p>é</p>", 1), (1, None, "<p>é</p>", 2), (2, "http://z", None, 3), (5, "http://q", "", 4), (4, "u", "WARC/1.1\r\n\r\n", 5), (6, "v", "x\n" * 5000, 6), (None, "n", "no id", 7), (None, "m", "<p>é</p>", 8)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, payload long")
    path = fresh_path(spark, "t")
    warc.write_archive(d, path)
    records = warc.reconstruct(spark, path)
    got = {(r.page_id, r.payload_digest): r for r in warc.parse(records).collect()}
    first = {}
    for p, _, h, _ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(h or "", p)
    for p, _, h, _ in rows:
        raw = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        r = got[(p, digest)]
        assert r.payload_bytes == len(raw)
        assert r.record_type == ("response" if first[h or ""] == p else "revisit")
        assert r.refers_to == (None if first[h or ""] == p else first[h or ""])
    by_page = {r.page_id: bytes(r.record) for r in records.where("page_id IS NOT NULL").collect()}
    ((fields, block),) = warc.parse_records(by_page[3])
    assert fields["WARC-Target-URI"] == "http://a/b%20c%0D%0Ax%09y%00z" and fields["WARC-Type"] == "revisit" and block.startswith(b"HTTP/1.1 200 OK")
    ((_, block),) = warc.parse_records(by_page[6])
    assert block.endswith(b"\r\n\r\n" + b"x\n" * 5000)
    out = fresh_path(spark, "t")
    warc.export(records, out)
    files = spark.read.format("binaryFile").load(out).select("content").collect()
    again = [b for f in files for b in warc.parse_records(zlib.decompress(bytes(f.content), 47))]
    assert sorted(f["WARC-Record-ID"] for f, _ in again) == sorted(next(iter(warc.parse_records(bytes(r.record))))[0]["WARC-Record-ID"] for r in records.collect())
    empty, twice = fresh_path(spark, "t"), fresh_path(spark, "t")
    warc.write_archive(d.limit(0), empty)
    assert warc.parse(warc.reconstruct(spark, empty)).collect() == []
    warc.write_archive(d.unionAll(d), twice)
    assert warc.parse(warc.reconstruct(spark, twice)).where("record_type = 'response'").count() == 5


def test_warc_hot_payloads_and_small_ones(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 20)
    monkeypatch.setattr(warc, "BLOB_BYTES", 2000)
    rows = [(i, f"http://h/{i}", "hot " * 100 if i % 3 else f"page {i} " + "q" * i) for i in range(300)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = fresh_path(spark, "t")
    warc.write_archive(d, path)
    got = {r.page_id: r for r in warc.parse(warc.reconstruct(spark, path)).collect()}
    assert len(got) == 300 and all(got[i].payload_bytes == len(h) for i, _, h in rows)
    assert [i for i in got if got[i].record_type == "revisit"] and all((got[i].refers_to == 1) == (i % 3 != 0 and i != 1) for i in got)
    small = fresh_path(spark, "t")
    warc.write_archive(d, small, min_revisit=401)
    assert {r.record_type for r in warc.parse(warc.reconstruct(spark, small)).collect()} == {"response"}


def test_warc_notices_a_changed_payload(spark):
    path = fresh_path(spark, "t")
    warc.write_archive(spark.createDataFrame([(1, "u", "abc"), (2, "v", "abcd")], "page_id long, url string, html string"), path)
    records = warc.reconstruct(spark, path)
    assert warc.parse(records).count() == 2
    with pytest.raises(Exception, match="speaks of another payload"):
        warc.parse(records.withColumn("record", F.expr("cast(replace(cast(record AS string), 'abc', 'abx') AS binary)"))).collect()


def tokens(name, end, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path(name))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], dtype="<u4") for x in texts]


ODD = ["", " a", "a  b", "a\tb c", "\nx\n", "é x y", "a\n\nb", "don't stop's", "<|endoftext|> x", " em space", "ΣΑΣ İx", "xy z", "Angström Å, é.", "a,b. c,, d..", "ＡＢ １２"]


@pytest.mark.parametrize(("name", "drops"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_cached_words_are_the_librarys(name, drops):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab é.,\n 'X9ß") for _ in range(40)) for _ in range(300)]
    e = WordCachedEncoder(public.path(name), drops, 50)
    want = [t[:-1].astype("<u2").tobytes() for t in tokens(name, 0, texts)]
    assert e.encode(texts) == want
    assert [e.encode([t])[0] for t in texts] == want


def test_packing(docs, rows, none):
    path = public.path("word_bpe_49k.json")
    want = sorted(tokens("word_bpe_49k.json", 1, [r[1] for r in rows]), key=lambda t: t.tobytes())
    got = packing.pack(docs, path, block=16).collect()
    assert sum(r.length for r in got) == sum(map(len, want))
    ids = {}
    for r, t in zip(rows, tokens("word_bpe_49k.json", 1, [r[1] for r in rows]), strict=True):
        ids[r[0]] = t
    sequences = {}
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert packing.pack(none, path).collect() == []


def test_differencing_keeps_windows_near_equal():
    rng = random.Random(2)
    sizes = [rng.randint(1, 512) for _ in range(400)]
    windows, k = packing.pack_block(sizes, 2048)
    full = [sum(s for s, w in zip(sizes, windows, strict=True) if w == i) for i in range(k)]
    assert max(full) <= 2048 and max(full) - min(full) < 40 and k <= -(-sum(sizes) // 2048) + 1
    assert packing.pack_block([2000, 2000, 100], 2048)[1] == 3
    assert packing.pack_block([], 2048) == ([], 1)


def test_token_files(spark, docs, rows, none):
    path = fresh_path(spark, "t")
    tokenids.write_ids(docs, path, public.path("byte_bpe_50k.json"), segment_ids=500)
    got = tokenids.read_ids(spark, path).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, row, ids in zip(got, order, tokens("byte_bpe_50k.json", 2, [x[1] for x in order]), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row[0], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    empty = fresh_path(spark, "t")
    tokenids.write_ids(none, empty, public.path("byte_bpe_50k.json"))
    assert tokenids.read_ids(spark, empty).collect() == []


def test_elias_fano():
    rng = random.Random(4)
    for n in (1, 2, 63, 64, 65, 700):
        values = sorted(rng.randint(0, 50 * n) for _ in range(n))
        e = tokenids.EliasFano.encode(np.array(values))
        assert e.all().tolist() == values and [e[i] for i in range(n)] == values
    ends = np.cumsum([rng.randint(1, 2000) for _ in range(5000)])
    e = tokenids.EliasFano.encode(ends)
    assert len(e.high) + len(e.low) + e.samples.nbytes < 8 * len(ends) / 4


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\b <s> [INST] <|im_end|>\n"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, None, None, "x"), (2, 5, "assistant", "é" * 3), (2, 5, "assistant", "a"), (None, 0, "ro\nle", "<"), (3, 0, "user", "<|im_start|>\\p\\b")]
    rows += [(9, i, ["user", "assistant"][i % 2], f"t{i} <|im_start|>") for i in range(700)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, chunk string, made long")
    path = fresh_path(spark, "t")
    chat.write_examples(d, path)
    streams, made_examples = chat.read_examples(spark, path)
    got = {r.conv_id: r for r in chat.read_back(streams, made_examples).collect()}
    turns = {}
    for c, t, role, text in rows:
        turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for c, ts in turns.items():
        ts.sort()
        said, loss = "".join(f"{r}\n{x}\n" for _, _, r, x in ts), "".join(x for _, _, r, x in ts if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(ts), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    small = made_examples.where("conv_id = 1")
    made = sorted(chat.materialise(streams, small).collect(), key=lambda r: r.example)
    assert len(made) == 2 and made[1].context.startswith(made[0].context + made[0].target)
    assert not any(c in made[0].target for c in chat.CONTROL)
    assert made_examples.where("conv_id = 9").count() == 350
    assert made_examples.where("conv_id = 9").select("example").distinct().count() == 350
    long = sorted(chat.materialise(streams, made_examples.where("conv_id = 9 AND example >= 340")).collect(), key=lambda r: r.example)
    stream = "".join(r.formatted for r in streams.where("conv_id = 9").orderBy("chunk").collect())
    for r in long:
        assert stream.startswith(r.context + r.target) and r.context.endswith("<|im_start|>assistant\n") and r.target.startswith(f"t{2 * r.example + 1} ")
    empty = fresh_path(spark, "t")
    chat.write_examples(d.limit(0), empty)
    assert chat.read_back(*chat.read_examples(spark, empty)).collect() == []


def test_sharding(spark, docs, rows, none):
    sized = sharding.sized(docs).cache()
    sizes = sharding.slot_sizes(sized)
    m = sharding.SlotMap.balanced(sizes, 4)
    got = sharding.assign(sized, m, sizes).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    g = m.grow(sizes)
    assert g.shards == 5 and g.version == 1 and all(b in (a, 4) for a, b in zip(m.shard, g.shard, strict=True))
    skewed = sharding.SlotMap([0] * sharding.SLOTS, 4)
    assert max(skewed.rebalance(sizes).loads(sizes)) < max(skewed.loads(sizes))
    empty = sharding.sized(none)
    assert sharding.assign(empty, sharding.current_map(spark, fresh_path(spark, "map"), {}), {}).collect() == []
    same = spark.createDataFrame([(None, "x")] * 500, "doc_id long, text string")
    assert sharding.sized(same).select("virtual_slot").distinct().count() > 400


def test_slot_map_versions(spark):
    rng = random.Random(3)
    sizes = {k: (rng.randint(100, 3000), 1) for k in range(4000)}
    path = fresh_path(spark, "map")
    first = sharding.current_map(spark, path, sizes, 40, 4096)
    assert first.version == 1 and first.drift(sizes) <= sharding.TOLERANCE
    assert sharding.SlotMap.load(spark, path, 0).shard == [k % 40 for k in range(4096)]
    assert sharding.current_map(spark, path, sizes, 40, 4096).version == 1  # nothing has drifted
    grown = {k: (b * (3 if k % 40 == 7 else 1), n) for k, (b, n) in sizes.items()}
    second = sharding.current_map(spark, path, grown, 40, 4096)
    assert second.version == 2 and second.drift(grown) <= sharding.TOLERANCE < first.drift(grown)
    assert sum(a != b for a, b in zip(first.shard, second.shard, strict=True)) < 1000  # an edit, not a new deal
    assert sharding.SlotMap.load(spark, path, 1).shard == first.shard
    with pytest.raises(Exception, match="exists"):
        second.store(spark, path)
    huge = {0: (10**9, 1)} | {k: (rng.randint(100, 200), 1) for k in range(1, 4000)}
    load = sorted(sharding.SlotMap.dealt(40, 4096).rebalance(huge).loads(huge))
    assert load[-1] == 10**9 and load[-2] - load[0] <= 0.01 * load[0]  # the others are level


def test_shards_are_near_equal(spark):
    out = sharding.op7_sharding(spark, "/root/testdata/sf0.1").groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("places")).collect()
    assert len(out) == 40 and all(r.places == r.n == r.last + 1 for r in out)
    mean = sum(r.b for r in out) / 40
    assert max(r.b for r in out) <= 1.01 * mean and min(r.b for r in out) >= 0.99 * mean


def distance(p, t):
    last = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        now = [i]
        for j, b in enumerate(t, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (a != b)))
        last = now
    return min(last)


def test_decontamination(spark, none):
    rng = random.Random(11)
    items = [(i, words(rng, 30)) for i in range(6)] + [(6, None), (7, "too short")]
    docs = [(0, None), (1, ""), (2, words(rng, 300))]
    for i, text in items[:6]:
        edited = text[:40] + "Q" + text[42:].replace(" ", "  ", 3)
        docs.append((10 + i, words(rng, 20) + ". " + (edited if i % 2 else text.upper()) + "! " + words(rng, 20)))
    docs.append((30, " ".join(items[0][1].split()[:21])))
    d, b = spark.createDataFrame([(*x, "z", "en", "s") for x in docs], "doc_id long, text string, item_id string, lang string, source string"), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for doc_id, text in docs:
        for item_id, item in items:
            if any(distance(p, decontaminate.normalised(text)) <= decontaminate.budget(len(p)) for p in decontaminate.windows(item)):
                want.add((doc_id, item_id))
    assert {(10 + i, i) for i in range(6)} | {(30, 0)} <= want
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()} == want
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b, block_bytes=200).collect()} == want
    assert {r.doc_id for r in decontaminate.clean(d, b).collect()} == {x[0] for x in docs} - {x for x, _ in want}
    assert decontaminate.contaminated(none, b).collect() == [] and decontaminate.contaminated(d, b.limit(0)).collect() == []


def test_quotes_in_part_and_with_replaced_words_are_found():
    rng = random.Random(14)
    items = [(i, words(rng, 60, "abcdefghijklmnop")) for i in range(20)]
    matcher = decontaminate.Matcher(items)
    some = lambda n: words(rng, n, "qrstuvwxyz")
    for i, text in items:
        w = text.split()
        for n in (13, 20, 24, 26):
            at = rng.randrange(len(w) - n + 1)
            assert [f[0] for f in matcher.find(some(30) + " " + " ".join(w[at : at + n]) + " " + some(30))] == [i]
        tenth = ["replacement" if k % 10 == 9 else x for k, x in enumerate(w)]
        fewer = [x for k, x in enumerate(w[10:30]) if k not in (5, 11)]
        more = w[10:16] + ["additional"] + w[16:19] + ["additional"] + w[19:23]
        for changed in (tenth, fewer, more):
            assert [f[0] for f in matcher.find(some(30) + " " + " ".join(changed) + " " + some(30))] == [i]
            assert [f[0] for f in matcher.find(" ".join(changed))] == [i]
        assert matcher.find(" ".join(x if k % 4 else "replacement" for k, x in enumerate(w))) == []
    for i in range(20):
        p = items[i][1].split()[3:16]
        (hit,) = decontaminate.Matcher([(7, " ".join(p))]).find("zz yy " + " ".join([*p[:5], "qq", *p[6:]]) + " xx")
        t = "zz yy " + " ".join([*p[:5], "qq", *p[6:]])
        assert hit == (7, 1, distance(" ".join(p), t + " xx"), len(t))


def test_short_items_and_scripts_without_blanks_are_found():
    rng = random.Random(15)
    find = lambda item, text: [(f[0], f[2], f[3]) for f in decontaminate.Matcher([(1, item)]).find(text)]
    assert find("Too short!", "it is too, SHORT to see") == [(1, 0, 15)] and find("Too short", "too short") == [(1, 0, 9)]
    assert find("Too short", "it is too shortly") == find("Too short", "ato short") == find("", "too short") == find("...", "...") == []
    for low, high in ((0x4E00, 0x9F00), (0x3041, 0x3090), (0x0E01, 0x0E2E)):
        some = lambda n, low=low, high=high: "".join(chr(rng.randrange(low, high)) for _ in range(n))
        item = some(60) + "\u3002" + some(80) + "\uff0c" + some(60)
        for a, b in ((0, 202), (10, 40), (70, 100)):
            assert [f[0] for f in find(item, some(50) + item[a:b] + some(50))] == [1]
        assert find(item, some(300)) == [] and [f[:2] for f in find(item[:5], some(9) + item[:5] + some(9))] == [(1, 0)]


def test_myers_is_the_edit_distance():
    rng = random.Random(6)
    for _ in range(200):
        p, t = ("".join(rng.choice("ab") for _ in range(rng.randint(1, n))) for n in (12, 20))
        hit = decontaminate.myers(p, t, len(p))
        assert hit is not None or distance(p, t) == len(p)
        if hit:
            assert hit[0] == distance(p, t)


def test_only_flawed_texts_are_joined_by_key(spark, monkeypatch):
    rows = [(i, f"shared line of the host\n{' '.join(f'w{i}x{j}' for j in range(30))}", "h") for i in range(40)]
    rows += [(100 + i, " ".join(f"v{i}x{j}" for j in range(30)), "h") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, seen, join = sorted(map(tuple, quality.accepted(d).collect())), [], quality.with_flaws
    monkeypatch.setattr(quality, "FEW", 0)
    monkeypatch.setattr(quality, "with_flaws", lambda rows, *more: seen.append(rows.count()) or join(rows, *more))
    assert sorted(map(tuple, quality.accepted(d).collect())) == want and len(want) == 440
    assert len(seen) == 1 and 40 <= seen[0] < 50
    monkeypatch.setattr(quality, "MARKS", 1)  # a full table of marks lets everything travel, with the same result
    assert sorted(map(tuple, quality.accepted(d).collect())) == want


def brute_quality(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {p + k for v in seen.values() if len(v) > 1 for p in v for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, rows, none):
    got = quality.assess(docs).collect()
    want = sorted((r[0] is None, r[0] or 0, *brute_quality(r[1])) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
    kept = sorted(str(r.doc_id) for r in got if r.kept)
    assert quality.assess(docs.where("source IS NULL").withColumn("source", F.lit(""))).where("kept").count() == quality.assess(docs.where("source IS NULL")).where("kept").count()
    assert quality.accepted(none).collect() == []
    out = quality.accepted(docs)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == kept
    assert quality.assess(none).collect() == []


def test_lines_of_many_documents_deplete(spark, monkeypatch):
    rng = random.Random(9)
    frame = "this very line stands in many of the pages of one host and says nothing of them"
    bodies = [words(rng, 2 if i < 3 else 40) for i in range(50)]
    rows = [(i, frame + "\n" + bodies[i], "h", i) for i in range(50)] + [(100, frame + "\n" + words(rng, 2), "other", 0), (101, None, None, 0), (102, "", "h", 0)]
    d = spark.createDataFrame(rows, ["doc_id", "text", "source", "a.b"])
    for limit in (quality.FEW, 0):  # broadcast, and joined by keys
        monkeypatch.setattr(quality, "FEW", limit)
        kept = {r.doc_id for r in quality.assess(d).where("kept").collect()}
        out = quality.accepted(d)
        left = {r.doc_id: r.text for r in out.collect()}
        assert out.columns == d.columns and kept == {*range(3, 50), 100} == set(left)
        assert all(left[i] == bodies[i] for i in range(3, 50)) and left[100] == rows[50][1]  # the line is gone where its host repeats it
    big = [(i, "line %d of the page has some words of its own that are %s\n" % (i, words(rng, 12)) + (frame + "\n" if i % 33 == 0 else "") + words(rng, 3 if i == 66 else 15), "big") for i in range(1000)]
    big[66] = (66, frame + "\n" + words(rng, 3), "big")
    got = {r.doc_id: r for r in quality.assess(spark.createDataFrame(big, "doc_id long, text string, source string")).collect()}
    assert [i for i in got if got[i].removed_words] == [i for i in got if i % 33 == 0] and not got[66].kept and got[33].kept  # 3 % of a large host
    copies = spark.createDataFrame([(i, frame + "\nand two more words here", "h") for i in range(60)], "doc_id long, text string, source string")
    assert quality.assess(copies).where("kept").count() == 60  # copies of one text count once


def test_licences(spark, none):
    texts = [None, "", "CC BY cc-by", "under the GNU General\nPublic License. General public license", "All rights reserved", "Released under the MIT License.", licences.TEMPLATES[1][1].upper(), "cc é by", "x " * 5000 + "licensed under the apache license version 2 0 now"]
    d = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licences.scan(d).collect()}
    assert [got[i].n_base for i in range(9)] == [0, 0, 2, 2, 1, 0, 0, 0, 0]
    assert got[2].base_labels == "cc-by" and got[3].base_labels == "gpl" and got[4].labels == "reserved"
    assert got[5].labels == "mit" and got[6].labels == "apache-2.0" and got[8].labels == "apache-2.0" and got[7].labels == ""
    assert (got[3].first_word, got[3].last_word) == (3, 6) and got[8].spans[0].start == 5000
    assert licences.scan(none).collect() == []


def test_suffix_automaton_matches_brute_force():
    rng = random.Random(8)
    for _ in range(50):
        seqs = [[rng.randrange(3) for _ in range(rng.randint(1, 12))] for _ in range(3)]
        text = [rng.randrange(4) for _ in range(30)]
        subs = {tuple(s[a:b]) for s in seqs for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
        a = licences.SuffixAutomaton(seqs)
        longest = [max((n for n in range(1, i + 1) if tuple(text[i - n : i]) in subs), default=0) for i in range(len(text) + 1)]
        want = [(i, longest[i]) for i in range(1, len(text) + 1) if longest[i] >= 2 and (i == len(text) or longest[i + 1] <= longest[i])]
        found = a.matches(text, 2)
        assert [(e, n) for e, n, _ in found] == want
        for e, n, state in found:
            for k, stop in a.ends[state].items():
                assert seqs[k][stop - n : stop] == text[e - n : e]


def test_every_place_of_every_template_is_matched():
    rng = random.Random(12)
    for _ in range(50):
        seqs = [[rng.randrange(3) for _ in range(rng.randint(1, 12))] for _ in range(3)]
        text = [rng.randrange(4) for _ in range(30)]
        same = lambda n, i, t: 0 <= i < len(text) and 0 <= t < len(seqs[n]) and text[i] == seqs[n][t]
        want = set()
        for n, seq in enumerate(seqs):
            for i in range(len(text)):
                for t in range(len(seq)):
                    if same(n, i, t) and not same(n, i - 1, t - 1):
                        k = next(k for k in range(1, 40) if not same(n, i + k, t + k))
                        want |= {(i + k, k, n, t + k)} if k >= 2 else set()
        found = licences.SuffixAutomaton(seqs, 2).matches_by_place(text)
        assert len(found) == len(want) and set(found) == want


def test_notice_before_words_of_another_template():
    scanner = licences.Scanner()
    notice = "Licensed under the Apache License, Version 2.0"
    for after in (". The files", ' (the "License"); see LICENSE', ' (the "License"); you may not', ". Now"):
        got = scanner.scan("x y z " + notice + after)
        assert got["labels"] == "apache-2.0" and got["score"] == 1.0 and ("apache-2.0", 3, 11) in got["spans"]
    twice = licences.Scanner([("t", "a b c d e p q r s t u a b c d f")], {})
    assert twice.scan("p q r s t u v a b c d")["labels"] == "t"  # the later place of a b c d
    assert licences.Scanner([("t", "a b c d e a b c d")], {}).scan("a b c d")["score"] == 4 / 9  # one run of the text does not cover two places


def test_licence_variants_are_told_apart():
    scanner = licences.Scanner()
    labels = lambda t: set(scanner.scan(t)["labels"].split(",")) - {"gpl", "reserved", "cc-by"}
    for name, version in (("General", "2"), ("General", "3"), ("Lesser General", "2.1"), ("Lesser General", "3"), ("Affero General", "3"), ("Library General", "2")):
        kind = {"General": "gpl", "Affero General": "agpl"}.get(name, "lgpl")
        notice = f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
        want = f"{kind}-{version if '.' in version else version + '.0'}"
        assert labels(notice) == {want}, want
        assert labels("see " + notice + " Also: " + licences.TEMPLATES[1][1]) == {want, "apache-2.0"}
    for kind, want in (("", "cc-by-4.0"), ("-ShareAlike", "cc-by-sa-4.0"), ("-NonCommercial", "cc-by-nc-4.0"), ("-NonCommercial-NoDerivatives", "cc-by-nc-nd-4.0")):
        assert labels(f"It is licensed under a Creative Commons Attribution{kind} 4.0 International License.") == {want}
    assert labels("It is licensed under a Creative Commons Attribution 2.5 Generic License.") == {""}
    assert labels("Licensed under CC BY-SA 4.0") == {"cc-by-sa-4.0"} and labels("Licensed under CC BY-SA 2.5") == set()
    whole = {label: text for label, text in licences.TEMPLATES if len(licences.words_of(text)) > 100}
    for label in ("mit", "isc", "bsd-2-clause", "bsd-3-clause", "gpl-1.0", "gpl-2.0", "gpl-3.0", "lgpl-2.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "apache-2.0", "mpl-2.0", "cc0-1.0"):
        assert label in labels(whole[label]) and scanner.scan(whole[label])["score"] == 1.0
        assert labels(whole[label]) == {label}, (label, labels(whole[label]))
    assert labels(whole["mit"] + "\n" + whole["bsd-3-clause"]) == {"mit", "bsd-3-clause"}


def brute_labels(templates, text):
    """Coverage of each template by its best chain of matches, from all matches and all orders of them: for short texts."""
    words = licences.words_of(text)
    out = {}
    for n, (_, t) in enumerate(templates):
        want = licences.words_of(t)
        same = lambda i, k, want=want: 0 <= i < len(words) and 0 <= k < len(want) and words[i] == want[k]
        runs = []
        for i in range(len(words)):
            for k in range(len(want)):
                if same(i, k) and not same(i - 1, k - 1):
                    size = next(x for x in range(1, 99) if not same(i + x, k + x))
                    if size >= licences.MIN_MATCH:
                        runs.append((i, i + size, k, k + size))
        runs.sort()
        best = [b - a for a, b, _, _ in runs]
        for x, (a, b, ta, tb) in enumerate(runs):
            for y in range(x):
                pa, pb, pta, ptb = runs[y]
                more = (b - a) - max(pb - a, ptb - ta, 0)
                if pb + licences.GAP >= a and more > 0:
                    best[x] = max(best[x], best[y] + more)
        out[n] = max(best, default=0) / len(want)
    return out


def test_chains_cover_what_brute_force_covers():
    rng = random.Random(41)
    vocabulary = [f"w{i}" for i in range(12)]
    for _ in range(60):
        templates = [(f"l{n}", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 25)))) for n in range(3)]
        scanner = licences.Scanner(templates, {})
        pieces = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(templates)[1].split()
            at = rng.randrange(len(w))
            pieces += w[at : at + rng.randint(3, 20)] + [rng.choice(["zz", *vocabulary]) for _ in range(rng.randint(0, 6))]
        text = " ".join(pieces)
        want = brute_labels(templates, text)
        got = scanner.scan(text)
        assert abs(got["score"] - max(want.values())) < 1e-12
        assert (got["labels"] == "") == (max(want.values()) < licences.COVERED)


def test_equal_templates_and_repeated_texts(spark):
    scanner = licences.Scanner([("one", "a b c d e f"), ("two", "a b c d e f")], {})
    assert scanner.scan("a b c d e f")["labels"] == "one"  # of equal coverage, the first
    assert scanner.scan("a b c d e f . a b c d e f")["labels"] == "one"
    text = "x " * 3 + "All rights reserved, CC BY, all rights reserved"
    rows = licences.scan(spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")).drop("doc_id", "spans").distinct().collect()
    assert len(rows) == 1 and (rows[0].n_base, rows[0].first_word, rows[0].last_word, rows[0].base_labels) == (3, 3, 8, "cc-by,reserved")


def test_many_licences_are_known():
    scanner = licences.Scanner()
    assert len({label for label, _ in licences.TEMPLATES}) >= 50
    own = lambda t: set(scanner.scan(t)["labels"].split(",")) - {"gpl", "reserved", "cc-by", ""}
    for label in ("mit", "isc", "epl-2.0", "cc0-1.0", "cc-by-sa-4.0", "lgpl-2.1", "apache-2.0", "bsd-3-clause", "agpl-3.0", "mit-0"):
        assert own(f"# SPDX-License-Identifier: {label.upper()}\nimport x") == {label}
    missed = [label for label, t in licences.TEMPLATES if label not in own(t) and not (label == "bsd" or len(licences.words_of(t)) > licences.NOTICE)]
    assert missed == []
    assert own("We spoke about the license identifier of the software and its terms.") == set()


def test_decontamination_of_long_and_repeated_texts(spark):
    rng = random.Random(51)
    item = words(rng, 40)
    filler = " ".join(words(rng, 50, "mnop") for _ in range(400))
    docs = [(1, filler + " " + item + " " + filler), (1, filler + " " + item + " " + filler), (2, filler * 2), (3, (item + " ") * 50), (None, item)]
    d = spark.createDataFrame([(*r, i) for i, r in enumerate(docs)], ["doc_id", "text", "a.b"])
    b = spark.createDataFrame([(7, item), (7, item), (None, item)], "item_id long, text string")
    got = sorted((str(r.doc_id), str(r.item_id), r.distance) for r in decontaminate.contaminated(d, b).collect())
    assert got == sorted((x, y, 0) for x in ("1", "1", "3", "None") for y in ("7", "7", "None"))
    left = decontaminate.clean(d, b)
    assert left.columns == d.columns and [r["a.b"] for r in left.collect()] == [2]


def test_packing_of_ties_and_of_whole_windows(spark):
    path = public.path("word_bpe_49k.json")
    one = "same words in each of them "
    d = spark.createDataFrame([(i, one * 30) for i in range(200)] + [(500 + i, "word " * 9000) for i in range(3)], "doc_id long, text string").repartition(3)
    got = packing.pack(d, path, block=64).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.doc_id, r.start))
    for parts in sequences.values():
        at = 0
        for offset, length, *_ in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    whole = [p for p in sequences.values() if p[0][1] == packing.WINDOW]
    assert len(whole) == 3 * (9001 // packing.WINDOW) and all(len(p) == 1 for p in whole)
    used = sum(r.length for r in got)
    assert used >= 0.9 * packing.WINDOW * len(sequences)  # eleven ties of 181 ids fill 97 % of a window


def test_token_files_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(tokenids, "FILE_SEGMENTS", 2)
    d = spark.createDataFrame([(i, "some words here and there " * 20) for i in range(60)], "doc_id long, text string")
    path = fresh_path(spark, "t")
    tokenids.write_ids(d, path, public.path("byte_bpe_50k.json"), segment_ids=300)
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    segments = [list(tokenids.segments(bytes(f.content))) for f in files]
    assert len(files) > 3 and max(map(len, segments)) <= 2
    got = tokenids.read_ids(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == list(range(60))
    some = segments[0][0]
    assert (np.concatenate([some.document(i) for i in range(some.n_docs)]) == some.ids).all()


def test_stages_keep_columns_of_any_name(spark):
    """Every filtering stage on nulls, repeated rows, clashing and dotted names, and an empty table."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    rng = random.Random(61)
    texts = [None, "", "no", *[words(rng, 40, "etaoinshrdl") for _ in range(6)]]
    rows = [(i, t, ["en", None][i % 2], ["s", None][i % 3 == 0], len(t or ""), i, "r", "g", i, "k", "c") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 5, 3, "r", "g", 3, "k", "c"), (None, texts[4], None, None, None, 9, "r", "g", 9, "k", "c")]
    d = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", "a.b", "_row", "t", "gone", "block", "c0"])
    stages = [f for _, f in corpus_pipeline.STAGES[:4]]
    for stage in stages:
        out = stage(spark, d, sf)
        assert out.columns == d.columns and all(r["a.b"] is not None and r["_row"] == "r" for r in out.collect())
        assert stage(spark, d.limit(0), sf).collect() == []
    assert corpus_pipeline.pack(spark, d.limit(0), sf).collect() == []
    assert {r.doc_id for r in corpus_pipeline.pack(spark, d, sf).collect()} == {*range(9), None}


def near(window, text, bigrams):
    """Whether a window lies within its budget of characters or of words somewhere in a normalised text."""
    own = window.split(" ")
    if window in text:
        return len(own) >= decontaminate.MIN_WORDS or f" {window} " in f" {text} "
    if len(own) < decontaminate.MIN_WORDS or sum(p in bigrams for p in zip(own, own[1:], strict=False)) < 2:
        return False
    e = decontaminate.budget(len(window))
    if decontaminate.myers(window, text, e) is not None:
        return True
    return decontaminate.word_budget(len(own)) > 0 and decontaminate.myers(own, text.split(" "), decontaminate.word_budget(len(own))) is not None


def test_pipeline_against_brute_force(spark):
    """The documents that the whole pipeline keeps, found stage by stage in plain Python."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).collect()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "quality rules", "near-dedup", "decontamination", "packing"]
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    texts = {r.doc_id: r.text for r in rows if langid.codes(r.text).size}
    train = [(r.text, r.lang) for r in rows if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    scored = dict(zip(texts, brute_bayes(train, texts.values()), strict=True))
    texts = {i: t for i, t in texts.items() if scored[i][1] >= 0.5}
    host = {r.doc_id: r.source or "" for r in rows}
    lines = lambda t: [re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ") for x in t.split("\n")]
    holders = {}
    for i, t in texts.items():
        for x in set(lines(t)) - {""}:
            holders.setdefault((host[i], x), set()).add(t)
    common = {k for k, v in holders.items() if len(v) > quality.MIN_DOCS}
    kept = {}
    for i, t in texts.items():
        n, _, _, _, repeats = brute_quality(t)
        own = set(lines(t)) - {""}
        size = lambda some: sum(x.count(" ") + 1 for x in some)
        left = {x for x in own if (host[i], x) not in common}
        if n >= 10 and 100 * repeats <= 20 * n and 100 * size(left) >= quality.KEPT_PERCENT * size(own):
            kept[i] = t if left == own else "\n".join(x for x, y in zip(t.split("\n"), lines(t), strict=True) if (host[i], y) not in common)
    sets = {i: brute_shingles(t) for i, t in kept.items()}
    root = {i: i for i in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in kept:
        for b in kept:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = {i: t for i, t in kept.items() if find(i) == i}
    windows = [p for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for p in decontaminate.windows(r.text)]
    want = {}
    for i, t in kept.items():
        normal = decontaminate.normalised(t)
        w = normal.split(" ")
        bigrams = set(zip(w, w[1:], strict=False))
        if not any(near(p, normal, bigrams) for p in windows):
            want[i] = t
    assert {r.doc_id for r in out} == set(want) and 100 < len(want) < len(rows)
    ids = dict(zip(want, tokens("word_bpe_49k.json", 1, want.values()), strict=True))
    pieces, sequences = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for held, whole in [(sorted(v), len(ids[k])) for k, v in pieces.items()] + [(sorted(v), None) for v in sequences.values()]:
        at = 0
        for start, length in held:
            assert start == at
            at += length
        assert at == whole or (whole is None and at <= packing.WINDOW)
