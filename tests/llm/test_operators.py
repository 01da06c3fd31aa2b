import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from quarry.llm import decontam, exact, graph, license, packing, pii, simhash, substring, toxicity, urls, warc

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, extra string, t string, n int, key string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, None) for r in rows], SCHEMA)


def texts(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    long = [" ".join(rng.choices(words, k=rng.randint(40, 300))) for _ in range(30)]
    rows = list(enumerate(long))
    rows += [(100 + i, long[i]) for i in range(5)] + [(200 + i, " ".join(rng.choices(words, k=30) + long[3].split()[:90] + rng.choices(words, k=30))) for i in range(25)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (None, long[0]), (304, "Éa x İi ﬁ 你好 <|endoftext|> don't 12½"), (5, long[5]), (305, "same " * 3000)]
    return rows


def test_substring_against_brute_force(spark):
    rows = texts()
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(table(spark, rows), bucket=2).collect()]
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - 49):
                s = b" ".join(w[i : i + 50])
                first[s] = min(first.get(s, d), d)
    want = []
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - 49):
                if first[b" ".join(w[i : i + 50])] < d:
                    gone |= set(range(i, i + 50))
        want.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(want, key=key)
    again = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(table(spark, rows)).collect()]
    assert sorted(again, key=key) == sorted(want, key=key)


def test_simhash_against_brute_force(spark):
    rows = texts(2)

    def fp(t):
        w = (t or "").encode().split()
        s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.lower() if x.isascii() else x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [r for r in rows if r[0] != 304 and r[0] is not None]
    prints = [(d, fp(t)) for d, t in rows]
    component = {i: {i} for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4 and component[i] is not component[j]:
                component[i] |= component[j]
                for k in component[i]:
                    component[k] = component[i]
    want = sorted((d, f"{p:016x}", min(rows[k][0] for k in component[i])) for i, (d, p) in enumerate(prints))
    for most in (simhash.MEET, 2):
        assert sorted(map(tuple, simhash.simhash_components(table(spark, rows), most=most).collect())) == want


def test_near_groups_and_chunks(spark):
    rng = random.Random(3)
    base = [f"v{i}" for i in rng.choices(range(5000), k=400)]
    rows = [(i, " ".join(base[:40 * i] + [f"new{i}"] + base[40 * i + 1 :])) for i in range(8)] + [(50 + i, " ".join(f"z{i}_{k}" for k in range(200))) for i in range(4)]
    for most in (simhash.MEET, 4):
        got = {r.doc_id: r.keep_id for r in simhash.near_groups(table(spark, rows), most=most).collect()}
        assert got == dict.fromkeys(range(8), 0)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(60)]
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in label.items() if x in got} and all(a == b or a in got for a, b in edges)


def test_exact(spark):
    rows = texts()
    got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(table(spark, rows)).collect()}
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        for d in ids:
            assert got[d, hashlib.sha256(t.encode()).hexdigest()] == (keep, len(ids), d == keep)


def test_packing(spark):
    rows = texts()
    got = packing.pack(table(spark, rows), PATH, chunk=20, fan_in=8).collect()
    encode = Tokenizer.from_file(PATH)
    want = []
    for d, t in rows:
        ids = [*encode.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(d, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    assert len(ends) <= 1.1 * sum(r.length for r in got) / 2048 + 1


def test_tokenizer_equals_the_library():
    rng = random.Random(5)
    samples = ["".join(rng.choice("aZé'sßİǅ12½³ .,\n\t ́ẞ你Ως#$<|>") for _ in range(200)) for _ in range(60)] + ["<|startoftext|>x", "don't WE'LL", "\x1c\x85 a"]
    mine = packing.WordTokenizer(PATH)
    full = Tokenizer.from_file(PATH)
    for s, ids in zip(samples, mine.encode([s.encode() for s in samples]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == full.encode(s, add_special_tokens=False).ids


def test_decontamination_against_brute_force(spark):
    rows = texts()
    base = rows[0][1].split()
    items = [("b", " ".join(base[3:25])), ("a", "W1 w2"), ("c", None), ("d", "one"), ("e", "none of these words at all occur in any of the many texts here"), (None, " ".join(base[30:45]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    wins = [(i, w) for i, t in items for w in decontam.windows_of(decontam.words_of((t or "").encode()))]
    want = []
    for d, t in rows:
        w = decontam.words_of((t or "").encode())
        hit, found = set(), set()
        for item, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    found |= {item} - {None}
        want.append((d, len(w), len(hit), len(found), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    key = lambda r: (r[0] is None, r)
    for block in (decontam.BLOCK_BYTES, 60):
        got = [tuple(r)[:6] for r in decontam.decontaminate(table(spark, rows), bench, block_bytes=block).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)


RULES = [urls.Rule("block", "com", "/en/"), urls.Rule("allow", "example.com", "/en/7"), urls.Rule("block", "a.b.com", "/")]


@pytest.mark.parametrize("block", [100, 1])
def test_urls(spark, block):
    cases = {
        "http://x.COM/en/1": "block", "https://Example.com/en/77?q": "allow", "http://www.example.com/en/8": "block", "http://xexample.com/EN/": "allow", "http://c.a.b.com/z": "block",
        "x": "allow", "http://com?/en/": "allow", "http://com/en/#x": "block", "://com/en/": "block", "http://x.com:80/en/": "allow", "": "allow",
    }
    pages = spark.createDataFrame([*enumerate(cases), (99, None), (99, None)], "page_id long, url string")
    got = urls.filter_urls(pages, RULES, block_rules=block).collect()
    assert len(got) == len(cases) + 2
    assert {r.page_id: r.verdict for r in got} == {**dict(enumerate(cases.values())), 99: "allow"}


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "x", None), (4, "x\r\ny", ""), (None, "x", "<p>é</p>"), (7, "x", "z" * 100000), (7, "x", "z" * 100000)]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), archive_bytes=300)
    got = warc.read_archives(archives).collect()
    assert sorted((r.page_id is None, r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == [
        (False, 1, "response", None, 9), (False, 2, "revisit", 1, 9), (False, 3, "response", None, 0), (False, 4, "revisit", 3, 0), (False, 7, "response", None, 100000), (False, 7, "response", None, 100000), (True, None, "revisit", 1, 9)]
    assert all(bytes(r.payload) == "<p>é</p>".encode() for r in got if r.page_id == 1)
    record = warc.write_record(1, "u", b"abc")
    for bad in (record[:-9], record[:40] + b"\0\0" + record[42:]):
        with pytest.raises(warc.WarcError):
            [warc.parse_record(m) for m in warc.members(bad)]


def test_toxicity(spark):
    rng = random.Random(6)
    common = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(common, k=60) + (["grimblewort", "zorkface"] * 3 if i % 4 == 0 else []))) for i in range(600)] + [(900, None), (901, "")]
    docs, labels = table(spark, rows), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(900, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 602 and all(0 <= r.score <= 1 for r in got.values())
    assert sum(r.predicted == int(i % 4 == 0) for i, r in got.items() if i < 600) >= 590
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_pii():
    s = pii.Surrogates(b"k")
    text = "A.b@x.org, a.B@x.org, +1 (389) 555-5010, 389-555-5010, 4111 1111 1111 1111, 10.0.0.1, Mr. John Smith, DE89370400440532013000, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""
    new, kinds, distinct = s.replace(text)
    assert kinds == ["email", "email", "phone", "phone", "number", "ip", "name", "iban", "secret"] and distinct == 7
    assert not any(x in new for x in ("x.org,", "5010", "4111", "10.0.0.1", "John", "Smith", "89370400", "04dbebab"))
    assert len(new) >= len(text) - 9 and pii.Surrogates(b"k").replace(text)[0] == new != pii.Surrogates(b"l").replace(text)[0]
    images = [pii.permute(b"k" * 32, "t", 500, x) for x in range(500)]
    assert sorted(images) == list(range(500)) and all(x != i for i, x in enumerate(images))


def test_licenses(spark):
    rows = [(1, "Prose here.\nReleased under the MIT License.\nMore prose."), (2, "nothing"), (3, None), (4, "x\n" + license.TEMPLATES["Apache-2.0"][1].replace(". ", ".\n")), (5, "Licensed under CC BY-NC 4.0."), (6, "A license to kill, says he.")]
    got = {r.doc_id: r.licenses for r in license.scan_licenses(table(spark, rows)).collect()}
    assert got == {1: ["MIT"], 2: [], 3: [], 4: ["Apache-2.0"], 5: ["CC-BY-NC-4.0"], 6: []}


def test_empty_tables(spark):
    docs = table(spark, [])
    for frame in (substring.substring_dedup(docs), simhash.simhash_components(docs), exact.exact_dedup(docs), packing.pack(docs, PATH), pii.surrogate_pii(docs, "k"), license.scan_licenses(docs), decontam.decontaminate(docs, spark.createDataFrame([], "item_id long, text string"))):
        assert frame.count() == 0


def near_copies(seed=6):
    """Texts and edited copies of them: passages appended, cut and replaced, single words changed; and a passage that many share."""
    rng = random.Random(seed)
    new = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    rows, line = [], new(40)
    for kind in ("append", "cut", "replace", "words"):
        for i in range(30):
            base = new(rng.randint(60, 300))
            n = int(len(base) * rng.uniform(0.03, 0.25))
            at = rng.randrange(len(base) - n)
            if kind == "words":
                other = [w if rng.random() > 0.04 else "edited" for w in base]
            else:
                other = base + new(n) if kind == "append" else base[:at] + (new(n) if kind == "replace" else []) + base[at + n :]
            rows += [" ".join(base), " ".join(other)]
    rows += [" ".join(new(35) + line) for _ in range(40)] + [" ".join(line + new(9) if i % 3 else line + new(3)) for i in range(40)] + ["one two", "One  TWO", "one two three"]
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


def brute_groups(rows, similarity=0.8):
    """The smallest id near each id, over all pairs."""
    sets = {}
    for d, t in rows:
        w = (t or "").lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in sets}
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) * 10 >= round(similarity * 10) * len(sets[a] | sets[b])]
    for _ in range(len(near)):
        before = dict(label)
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    many = {d for p in near for d in p}
    return {d: c for d, c in label.items() if d in many}


def test_near_groups_against_all_pairs(spark):
    rows = near_copies()
    want = brute_groups(rows)
    assert len(want) > 100
    for most in (simhash.MEET, 8):
        assert {r.doc_id: r.keep_id for r in simhash.near_groups(table(spark, rows), most=most).collect()} == want


def test_pii_names_after_punctuation():
    for text in ("(Mr. Smith) spoke", 'said "Dr. Jones', "and/or Mrs. White", "die \u2013Frau Weber"):
        new, kinds, _ = pii.Surrogates(b"k").replace(text)
        assert kinds == ["name"] and new.split()[-1] != text.split()[-1] or "Smith" not in new and kinds == ["name"], text


def test_licenses_side_by_side(spark):
    full = {k: v[-1] for k, v in license.TEMPLATES.items()}
    rows = [(1, full["MIT"] + "\n" + full["Apache-2.0"]), (2, "All rights reserved.\n" + full["BSD-3-Clause"]), (3, "\n".join(full[x] for x in ("ISC", "MPL-2.0", "CC0-1.0", "GPL-2.0", "CC-BY-4.0", "Proprietary"))), (4, "license " + "x " * 3500 + full["MIT"] + " y" * 3500)]
    got = {r.doc_id: set(r.licenses) for r in license.scan_licenses(table(spark, rows)).collect()}
    assert got == {1: {"MIT", "Apache-2.0"}, 2: {"Proprietary", "BSD-3-Clause"}, 3: {"ISC", "MPL-2.0", "CC0-1.0", "GPL-2.0", "CC-BY-4.0", "Proprietary"}, 4: {"MIT"}}


def test_near_copies_of_one_id(spark):
    import corpus_pipeline

    words = [f"q{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(words + ["more"])), (2, " ".join(f"clean{i}" for i in range(50))), (3, " ".join(["less"] + words))]
    got = {(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, table(spark, rows), "").collect()}
    assert got == {rows[0], rows[2]}


def test_warc_of_others(spark, tmp_path):
    """Records as other writers make them: folded and Latin-1 headers, SHA-256 digests, no digest; from a file."""
    import gzip

    def record(body, *head):
        return gzip.compress(b"\r\n".join([b"WARC/1.0", b"WARC-Type: resource", *head, b"Content-Length: %d" % len(body)]) + b"\r\n\r\n" + body + b"\r\n\r\n")

    sha = hashlib.sha256(b"one").hexdigest().encode()
    good = [record(b"one", b"WARC-Target-URI: http://a/\xe9", b"WARC-Block-Digest: sha256:" + sha), record(b"", b"WARC-Target-URI: http://\r\n b"), record(b"x" * 300_000, b"WARC-Block-Digest: crc9:77")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(good))
    got = warc.read_files(spark, f"file://{tmp_path}/a.warc.gz").collect()
    assert [(r.url, r.payload_bytes) for r in got] == [("http://a/\xe9", 3), ("http:// b", 0), (None, 300_000)]
    with pytest.raises(warc.WarcError):
        warc.parse_record(next(warc.members(record(b"two", b"WARC-Block-Digest: sha256:" + sha))))


def test_warc_beyond_the_broadcast(spark):
    rows = [(i, "u", "same" if i % 3 else f"p{i}", "x") for i in range(60)] + [(None, None, None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string")
    a, b = (sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to or -1, r.payload_digest) for r in warc.read_archives(warc.write_archives(pages, most=m)).collect()) for m in (500_000, 0))
    assert a == b and len(a) == 61 and sum(r[2] == "revisit" for r in a) == 39
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_exact_beyond_the_broadcast(spark):
    rows = texts()
    a, b = (sorted(map(str, exact.exact_dedup(table(spark, rows), most=m).collect())) for m in (500_000, 0))
    assert a == b


def test_urls_edges(spark):
    long = "http://" + "a." * 2000 + "com/en/" + "x" * 100_000
    pages = spark.createDataFrame([(1, long, 1, "h", "r"), (1, long, 1, "h", "r"), (None, "http://com/en/", 2, "h", "r")], "page_id long, url string, key int, host string, rule string")
    for block in (100, 1):
        got = urls.filter_urls(pages, [*RULES, urls.Rule("allow", "a." * 2000 + "com", "/")], block_rules=block).collect()
        assert sorted((r.page_id or 0, r.verdict) for r in got) == [(0, "block"), (1, "allow"), (1, "allow")]
    assert urls.filter_urls(pages.limit(0), RULES).count() == 0 and urls.filter_urls(pages, []).count() == 3


def test_packing_goes_on_to_the_end(spark):
    """Bins of many tasks: no two that are at most half full are left."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["one", "two", "tree"], k=rng.choice([900, 1100, 1300, 1500])))) for i in range(60)]
    got = packing.pack(table(spark, rows).repartition(16), PATH, chunk=2, fan_in=4).collect()
    sizes = {}
    for r in got:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert sum(2 * s <= 2048 for s in sizes.values()) <= 1 and max(sizes.values()) <= 2048


def test_another_tokenizers_file(tmp_path):
    """A file that splits otherwise goes to the library, word by word cached or not."""
    import json

    content = json.load(open(PATH, encoding="utf-8"))
    content["normalizer"] = None
    (tmp_path / "t.json").write_text(json.dumps(content))
    mine, full = packing.WordTokenizer(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json"))
    for s in ("Some Text  here's 12", ""):
        assert np.frombuffer(next(mine.encode([s.encode()])), "<u4").tolist() == full.encode(s, add_special_tokens=False).ids
