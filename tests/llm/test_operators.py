"""Every operator against brute force on small tables with awkward rows."""

import hashlib
import html
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from ohlcraft.llm import components, decontam, flat_graph, html_template, licenses, mixing, pii, records, separator_scan, simhash, toxicity
from ohlcraft.llm.crc32c import crc32c, masked
from ohlcraft.llm.encoding import default_tokenizer, encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, path string, __text string, fp long, tokens string"


def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    texts += [None, "", "   \n\t ", "one", "two words", "three little words", "Äß 漢字 😀 é́ İ", "x" * 30_000, "w " * 20_000, "A\x1cB \x85 C\xa0D don'T.  <|endoftext|> \"q\" 12.34,"]
    texts += [texts[0], texts[0].upper(), texts[1] + " tail", texts[2].replace(" ", "\n", 3)]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", "src12", None]), 0, "id", None, "t", 7, "n") for i, t in enumerate(texts)]
    return [*out, out[0], out[0], (None, texts[3], "en", "src1", 0, "", "", "", 0, ""), (3, "another text of id three", "en", "src1", 0, "", "", "", 0, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_crc32c():
    assert crc32c([b"123456789"])[0] == 0xE3069283
    data = [bytes(random.Random(n).randbytes(n)) for n in (4, 5, 63, 64, 65, 1000)]

    def slow(x):
        c = 0xFFFFFFFF
        for b in x:
            c ^= b
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert crc32c(data).tolist() == [slow(x) for x in data]
    c = slow(data[0])
    assert masked(crc32c(data[:1]))[0] == ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_encoder_equals_whole_text():
    from tokenizers import Tokenizer

    whole, enc = Tokenizer.from_file(default_tokenizer()), encoder(default_tokenizer())
    for r in rows():
        t = r[1] or ""
        assert np.frombuffer(enc.encode(t.encode()), enc.dtype).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_frame_round_trip_and_damage():
    items = [b"", b"abcd" * 9, b"12345"]
    items = [struct.pack("<I", i) + x for i, x in enumerate(items)]
    framed = records.frame(items)
    offsets = np.cumsum([0, *map(len, framed)])[:-1].tolist()
    data = b"".join(framed)
    assert records.unframe(data, offsets) == items
    bad = bytearray(data)
    bad[20] ^= 1
    with pytest.raises(ValueError):
        records.unframe(bytes(bad), offsets)
    with pytest.raises(ValueError):
        records.unframe(data[:-3], offsets)


def test_token_records(docs, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_tokenizer())
    got = sorted(map(tuple, records.token_records(docs).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows()), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    want = []
    for r in rows():
        ids = [*whole.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.append((r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(((r[0], r[2], r[3]) for r in got), key=repr) == sorted(want, key=repr)
    assert records.token_records(empty).count() == 0


@pytest.mark.parametrize("block", [2, 6, 1000, 1 << 20])
def test_separator_scan(spark, docs, empty, block, tmp_path):
    got = sorted(map(tuple, separator_scan.token_counts(docs, block_bytes=block * 50).collect()), key=lambda r: r[1])
    enc = encoder(default_tokenizer(), True)
    want = sorted(len(enc.encode((r[1] or "").encode())) // 2 + 1 for r in rows())
    assert sorted(r[2] for r in got) == want
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    # flat files of other making: documents over many blocks, an open end, an empty file
    files = {"a": [5, 9, 9, 7, 7, 7, 7, 9, 3], "b": [9], "c": [1] * 30, "d": []}
    table = []
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
        table.append((str(tmp_path / name), 2 * len(ids)))
    out = separator_scan.scan_flat(spark, spark.createDataFrame(table, "path string, n_bytes long"), 2, 9, block)
    found = sorted((r.path[-1], r.seq, r.start, r.n_tokens) for r in out.collect())
    assert found == [("a", 0, 0, 2), ("a", 1, 2, 1), ("a", 2, 3, 5), ("a", 3, 8, 1), ("b", 0, 0, 1), ("c", 0, 0, 30)]
    if block == 2:
        assert separator_scan.token_counts(empty).count() == 0


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(docs, empty):
    got = simhash.simhash_dedup(docs).collect()
    fps = [(r[0], slow_fingerprint(r[1] or "")) for r in rows()]
    assert sorted((r[0] is None, r[0], r[1]) for r in got) == sorted((i is None, i, f"{f:016x}") for i, f in fps)
    some = [(i, f) for i, f in fps if i is not None]
    least = {}
    for i, f in some:
        least[f] = min(i, least.get(f, i))
    comp = components_of(set(least.values()), [(least[f], least[g]) for f in least for g in least if (f ^ g).bit_count() <= 4])
    for r in got:
        assert r[2] == (None if r[0] is None else comp[least[int(r[1], 16)]])
    assert simhash.simhash_dedup(empty).count() == 0
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    stayed = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in stayed if i is not None) == sorted(i for i, f in set(some) if comp[least[f]] == i) and stayed.count(None) == sum(i is None for i, _ in fps)
    assert simhash.keep_one_of_each(empty).count() == 0


def test_simhash_rows_of_one_id(spark):
    """One id with two texts that aren't near: both stay; repeated rows, and copies in other case, stay once."""
    a, b = "one two three four five six seven", "completely other words stand in this text"
    table = [(1, a, 0), (1, a, 0), (1, a.upper(), 1), (1, b, 2), (2, a, 3), (3, b, 4), (4, "a third text of quite some words", 5)]
    kept = simhash.keep_one_of_each(spark.createDataFrame(table, "doc_id long, text string, __id long"))
    got = [(r.doc_id, r.text.lower()) for r in kept.collect()]
    assert sorted(got) == sorted([(1, a), (1, b), (4, table[-1][1])])


def test_simhash_pigeonring_finds_all_pairs(spark, monkeypatch):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for f in fps[:40]:
        for _ in range(12):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 6)):
                g ^= 1 << b
            fps.append(g)
    fps = sorted(set(fps))
    want = components_of(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    table = spark.createDataFrame([(i, simhash._signed(f)) for i, f in enumerate(fps)], "id long, fp long")
    for block in (simhash.BLOCK, 3):  # 3: nearly every key is hot and dealt out as pairs of blocks
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert {r.rep: r.component for r in simhash.near_duplicate_classes(table).collect()} == want


def test_long_word_chunks():
    for text in ("ab " * 900_000 + "tail of it", "y" * 2_500_000 + " a b c d", "z" * 1_048_576 + "\nq r s t u"):
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == components_of({x for e in real for x in e}, real)
    a, b = components.spanning_forest(np.array([e[0] for e in real]), np.array([e[1] for e in real]))
    assert components_of(set(got), list(zip(a.tolist(), b.tolist(), strict=True))) == got
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 10)
    rng = random.Random(8)
    edges = [(0, i) for i in range(1, 400)] + [(1000, rng.randrange(1001, 1400)) for _ in range(300)] + [(399, 5000), (5000, 5001)] + [(2000 + i, 2001 + i) for i in range(30)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components_of({x for e in edges for x in e}, edges)


def slow_base(x):
    out, digits = [], lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        t = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(v - 9 * (v > 9) for v in t) % 10 == 0

    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ):
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, x) if ok(m.group())]
    return out


def test_pii_base_spans(spark, docs, empty):
    rng = random.Random(2)
    odd = ["a@b.c_d@e.f x@y@z.com aaa@@b.c 1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 +1 (988) 555-2485 4041894974608795, 4041-8949 7460 8795 é😀 q.4@m.org.", "a" * 50_000, "1" * 30_000 + " 1.1.1.1", "a@b" + ".c" * 9000, "9 " * 9000, "x@y.z "*2000, None, ""]
    odd += ["".join(rng.choice("ab1.@+-( )5😀é _%") for _ in range(200)) for _ in range(150)]
    got = pii.digest(pii.find_private(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"))).collect()
    for r in got:
        want = slow_base(odd[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
    assert pii.digest(pii.find_private(docs)).count() == len(rows())
    assert pii.digest(pii.find_private(empty)).count() == 0


def test_pii_disclosing_terms(spark):
    table = [(i, f"the Nightingale wrote from jo@x.org about the weather {i}") for i in range(5)] + [(10 + i, f"the weather was fine, about {i}") for i in range(40)] + [(99, "call al@y.org about the Nightingale")]
    found = {r.doc_id: r for r in pii.find_private(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    for i in range(5):
        terms = {t.v: t.act for t in found[i].terms}
        assert set(terms) == {"wrote", "from", "nightingale"} and terms["wrote"] == "remove", terms
        assert all(table[i][1][t.s : t.e].lower() == t.v for t in found[i].terms)
    assert all(not found[i].terms for i in found if i >= 10)
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert clean[0] == "the    [EMAIL] about the weather 0"  # no beginning of the three is common
    assert clean[99].startswith("call [EMAIL]")


def test_pii_entity_of_one_document(spark):
    table = [(0, "write to solo@x.org about the oriole"), (1, "the oriole sings about")] + [(2 + i, "we write to you about the weather") for i in range(100)]
    found = {r.doc_id: [(t.v, t.act) for t in r.terms] for r in pii.find_private(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert found[0] == [("oriole", "remove")] and not any(found[i] for i in found if i)  # strong, and no beginning of it is common


def test_pii_disclosure_by_loops(spark):
    """Terms, what is done with them and the clean text, from plain counts of documents."""
    import math

    rng = random.Random(12)
    common = ["the", "or", "orange", "weather", "fine", "was", "about", "no", "north", "pen"]
    table = []
    for i in range(300):
        words = [rng.choice(common) for _ in range(rng.randint(3, 12))]
        if i % 10 == 0:
            who = i // 10 % 6
            words += [f"mail{who}@x.org", ["oriole", "nordic", "penguin", "zebra", "fin", "weathers"][who]]
            if who < 3 and rng.random() < 0.5:
                words.append("call +1 555 010 0200")
        elif i % 17 == 0:
            words.append(rng.choice(["oriole", "nordic", "penguin", "zebra", "fin", "weathers"]))
        rng.shuffle(words)
        table.append((i, " ".join(words)))
    got = {r.doc_id: r for r in pii.find_private(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    entities, words = {}, {}
    for i, x in table:
        entities[i] = {m for m in re.findall(r"mail[0-9]@x.org|[+]1 555 010 0200", x)}
        words[i] = set(re.findall("[a-z]+", re.sub(r"mail[0-9]@x.org", "", x)))
    n = len(table)
    nt = Counter(w for ws in words.values() for w in ws)
    ne = Counter(e for es in entities.values() for e in es)
    acts = Counter()
    for i, x in table:
        want = {}
        for w in words[i]:
            strong = []
            for e in entities[i]:
                both = sum(w in words[j] and e in entities[j] for j in words)
                s = math.log(n * both / (nt[w] * ne[e])) / math.log(n / ne[e])
                if nt[w] >= 2 and s >= pii.GENERALISE:
                    strong.append((s, ne[e]))
            if strong:
                most = max(k for _, k in strong)
                bound = n ** (1 - pii.GENERALISE) * most**pii.GENERALISE
                begins = [w[:k] for k in range(len(w) - 1, 0, -1) if max((c for v, c in nt.items() if c >= 2 and len(v) > k and v.startswith(w[:k])), default=0) > bound]
                want[w] = ("generalise", begins[0] + "*") if max(strong)[0] < pii.REMOVE and begins else ("remove", "")
        assert {t.v: (t.act, t.to) for t in got[i].terms} == want, (x, want)
        acts.update(a for a, _ in want.values())
        out = re.sub(r"mail[0-9]@x.org", "[EMAIL]", x)
        for w, (_, to) in want.items():
            out = re.sub(rf"(?<![A-Za-z\[])\b{w}\b", to, out)
        assert clean[i] == out.replace("+1 555 010 0200", "[PHONE]"), (clean[i], out)
    assert acts["generalise"] > 3 and acts["remove"] > 3, acts


def test_pii_terms_far_from_the_entity(spark):
    filler = "we write to you about the weather " * 40
    table = [(i, f"Oriole {filler} oriole {filler} jo@x.org tel@y.org") for i in range(3)] + [(3 + i, filler) for i in range(100)] + [(200, f"oriole@z.org {filler}"), (0, "Oriole alone"), (None, f"Oriole {filler} jo@x.org tel@y.org")]
    got = pii.find_private(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(table)
    for r in got:
        want = [(m.start(), m.end(), "oriole", "remove", "") for m in re.finditer("oriole", r.text, re.I)] if "jo@x.org" in r.text else []
        assert [tuple(t) for t in r.terms] == want, (r.doc_id, r.terms)


def test_mixing(spark, docs, empty):
    for d in (docs, empty, docs.where("source = 'src0'")):
        d.createOrReplaceTempView("d")
        got = sorted(map(tuple, mixing.mix_documents(d).collect()), key=repr)
        con = duckdb.connect()
        documents = d.select("doc_id", "text", "lang", "source").toPandas()  # noqa: F841
        con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, lang::VARCHAR AS lang, source::VARCHAR AS source FROM documents")
        want = sorted(con.execute(mixing.ORACLE).fetchall(), key=repr)
        assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]
        back = mixing.mixed_rows(d)
        words = lambda x: len(re.findall(mixing.WORDS, x or ""))
        key = lambda r: (str(r.doc_id), r.lang or "", r.source or "", words(r.text))
        assert back.columns == d.columns
        assert sorted(map(key, back.collect())) == sorted((str(g[0]), g[2], g[3], g[4]) for g in got)


def test_mixing_of_repeated_and_null_ids(spark):
    """Half the rows have no id, or one id; the cut falls among rows with as many tokens."""
    table = [(None if i % 2 else 5 if i % 3 else i, " ".join(["w"] * (i % 4)) + (f" t{i}" if i % 5 else ""), ("en", "de", None)[i % 3], f"s{i % 2}") for i in range(240)]
    d = spark.createDataFrame(table, "doc_id long, text string, lang string, source string")
    documents = d.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, lang::VARCHAR AS lang, source::VARCHAR AS source FROM documents")
    want = sorted(map(str, con.execute(mixing.ORACLE).fetchall()))
    assert sorted(str(tuple(r)) for r in mixing.mix_documents(d).collect()) == want and len(want) > 50
    back = mixing.mixed_rows(d).collect()
    assert Counter((str(r.doc_id), len(r.text.split())) for r in back) == Counter((str(r.doc_id), r.tokens) for r in mixing.mix_documents(d).collect())
    most = Counter(map(tuple, d.collect()))
    assert all(n <= 2 * most[r] for r, n in Counter(map(tuple, back)).items())  # two epochs


def test_shares_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "3", 1000), ("b", "x", "4", 1000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, 0.2658, 1, {}).collect()}  # 800 of 3010 tokens, in hundredths: 26 %
    whole = 3010 * 27 // 100
    assert got["4"] == whole // 2 and got["1"] == 10 and got["2"] == whole // 2 // 2 - 10 and got["3"] == whole // 2 // 2


def test_toxicity(spark, empty):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    common = [word() for _ in range(400)]

    def text(bad, junk):
        w = [rng.choice(common) for _ in range(rng.randint(30, 80))]
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["zorkish", "zorkily", "quump", "vlaff"]))
        return (" %%% " if junk else " ").join(w)

    y = [(i, rng.random() < 0.2, rng.random() < 0.3) for i in range(700)]
    table = [(i, text(bad, junk)) for i, bad, junk in y]
    docs = spark.createDataFrame([*table, (None, "zorkish quump " + table[0][1]), (9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(not junk), int(bad)) for i, bad, junk in y if i < 400] + [(None, 1, 1), (5000, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(i, bad, junk) for i, bad, junk in y if i >= 400]
    assert sum(got[i].toxic == bad for i, bad, _ in held) >= 0.98 * len(held)
    assert sum((got[i].p_low_quality >= 0.5) == junk for i, _, junk in held) >= 0.95 * len(held)
    assert not got[9000].toxic and not got[9001].toxic and len(got) == 703
    kept = toxicity.keep_clean(docs.withColumn("p", docs.text), labels)
    assert kept.columns == ["doc_id", "text", "p"] and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.toxic}
    assert toxicity.toxicity(empty, labels).count() == 0
    none = toxicity.toxicity(docs, labels.limit(0))
    assert none.where("toxic").count() == 0 and none.count() == 703
    assert toxicity.keep_clean(empty, labels.limit(0)).count() == 0


def _plain_features(text):
    """The set of features by their definition, without caches."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    names = {f"w {w}" for w in words} | {f"{n} {w[:n]}" for w in words for n in (3, 4, 5) if len(w) > n}
    letters = sum(map(len, words))
    names |= {f"= n {int(np.log2(len(text) + 1))}", f"= l {round(2 * letters / len(words)) if words else 0}", f"= s {round(20 * letters / len(text)) if text else 0}", f"= d {round(10 * len(set(words)) / len(words)) if words else 0}"}
    return {zlib.crc32(x.encode("utf-8", "replace")) for x in names}


def test_toxicity_scores_by_loops(spark, monkeypatch):
    """Every probability from the chain's weights and plain feature sets: ties, repeats, very long texts and clashing names too."""
    kept = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a, **k: kept.append(fit(*a, **k)) or kept[-1])
    rng = random.Random(14)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7))) for _ in range(120)]
    table = []
    for i in range(200):
        w = [rng.choice(words) for _ in range(rng.randint(1, 40))] + (["vile", "vilely"] if i % 4 == 0 else []) + (["###"] * 9 if i % 3 == 0 else [])
        table.append((i, " ".join(w), 0.5, "p"))
    table += [(500, "vile " * 30_000, 0.1, "x"), (501, "x" * 200_000, 0.1, "x"), (502, None, 0.1, "x"), (None, "Vile!", 0.2, "x"), table[0], table[0]]
    docs = spark.createDataFrame(table, "doc_id long, text string, p_toxic double, toxic string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(150)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(table)
    chain = kept[0]
    for (i, text), r in zip(sorted(((str(t[0]), t[1] or "") for t in table), key=lambda e: e[0]), sorted(got, key=lambda r: str(r.doc_id)), strict=True):
        assert str(r.doc_id) == i
        before = []
        for m, p in zip(chain, (r.p_low_quality, r.p_toxic), strict=True):
            z = m.intercept + sum(m.weights.get(f, 0.0) for f in _plain_features(text)) + sum(a * b for a, b in zip(m.earlier, before, strict=True))
            before.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
            assert abs(before[-1] - p) < 1e-5
        assert r.toxic == (before[-1] >= toxicity.THRESHOLD) or abs(before[-1] - toxicity.THRESHOLD) < 1e-5
    assert chain[1].weights and chain[0].weights


def test_toxicity_optimum_over_all_features():
    """No feature that was left out would lower the loss; the later model learnt from out-of-fold probabilities."""
    rng = np.random.default_rng(6)
    n, names = 300, np.arange(900) * 7 + 3
    present = rng.random((n, 900)) < rng.uniform(0.02, 0.4, 900)
    y = np.stack([present[:, 850] | present[:, 3], present[:, 700] & ~present[:, 3]], axis=1).astype(float)
    folds = np.arange(n) % 3
    rows = [names[p] for p in present]
    toxicity_first = toxicity.FIRST_FEATURES
    try:
        toxicity.FIRST_FEATURES = 5  # the others have to come in by themselves
        chain = toxicity.train_chain(rows, y, folds)
    finally:
        toxicity.FIRST_FEATURES = toxicity_first
    counts = present.sum(0)
    some = counts >= toxicity.MIN_DOCS
    scale = np.sqrt(n / np.maximum(counts, 1))
    dense = np.empty((n, 0))
    for c, m in enumerate(chain):
        z = np.array([m.intercept + sum(m.weights.get(int(f), 0.0) for f in r) for r in rows]) + (dense @ np.array(m.earlier) if c else 0)
        slope = np.abs((1 / (1 + np.exp(-z)) - y[:, c]) @ present) * scale / n
        out = [j for j in range(900) if some[j] and int(names[j]) not in m.weights]
        assert slope[out].max() <= toxicity.PENALTY * toxicity.SLACK + 1e-9 and 0 < len(m.weights) < 900
        if c == 0:
            p = np.zeros(n)
            for k in range(3):
                train = folds != k
                one = toxicity.train_chain([r for r, t in zip(rows, train, strict=True) if t], y[train][:, :1], folds[train])[0]
                for i in np.flatnonzero(folds == k):
                    p[i] = 1 / (1 + np.exp(-(one.intercept + sum(one.weights.get(int(f), 0.0) for f in rows[i]))))
            dense = p[:, None]
    assert len(chain[1].earlier) == 1


def test_decontamination(spark, docs, empty):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(500)] + ["the", "of"] * 100
    passage = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [passage(n) for n in (12, 20, 40, 60)] + [["zq"], ["zq", "zz"], []]
    bench = spark.createDataFrame([(i, " ".join(w), "x") for i, w in enumerate(items)] + [(None, "null item of some words", "x"), (50, None, "x")], "item_id long, text string, doc_id string")
    table, want = [], set()
    for d in range(200):
        w = passage(rng.randint(50, 150))
        if d % 4 == 0:
            k = rng.randrange(4)
            copy = list(items[k])
            for _ in range(len(copy) // 10 if d % 8 else 0):  # edits: change, drop, add
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([["edited"], [], [copy[at], "added"]])
            at = rng.randrange(len(w))
            w[at:at] = copy
            want.add((d, k))
        table.append((d, (", " if d % 3 else "\n").join(w).upper()))
    table += [(300, None), (301, ""), (302, "zq"), (303, "ab zq zz."), (None, " ".join(items[1])), (0, table[0][1])]
    got = decontam.decontaminate(spark.createDataFrame(table, "doc_id long, text string").withColumn("item_id", docs_lit()), bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert pairs == want | {(302, 4), (303, 4), (303, 5), (None, 1)}
    assert sum(r.doc_id == 0 for r in got) == 2
    for r in got:
        assert r.share >= decontam.MIN_SHARE
    kept = decontam.keep_uncontaminated(spark.createDataFrame(table, "doc_id long, text string"), bench)
    assert {r.doc_id for r in kept.collect()} == {t[0] for t in table if t[0] is not None} - {d for d, _ in pairs}
    assert decontam.decontaminate(empty, bench).count() == 0 and decontam.decontaminate(docs, bench.limit(0)).count() == 0
    assert decontam.keep_uncontaminated(docs, bench.limit(0)).count() == len(rows())


@pytest.mark.parametrize("most", [1 << 27, 1 << 15])
def test_decontamination_against_all_alignments(spark, monkeypatch, most):
    """Every (document, item) pair by plain loops, with a wide and an overfull bitmap; repeated items of one id count once."""
    from ohlcraft.llm import bitmap

    monkeypatch.setattr(bitmap, "MOST", most)
    monkeypatch.setattr(decontam, "_BITS", decontam._BITS if most > 1 << 15 else 1)
    rng = random.Random(16)
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 25))] for _ in range(25)]
    table = []
    for d in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randrange(3)):
            copy = list(rng.choice(items))
            if len(copy) > 12:
                copy[rng.randrange(len(copy))] = "edited"
                copy = copy[rng.randrange(3) :]
            at = rng.randrange(len(w) + 1)
            w[at:at] = copy
        table.append((d, " ".join(w)))
    bench = [(i, " ".join(w)) for i, w in enumerate(items)]

    def best(a, b):
        h, top = [0] * (len(b) + 1), 0
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(max(0, h[j] + (1 if x == y else -1), h[j + 1] - 1, row[j] - 1))
            h, top = row, max(top, *row)
        return top

    true = {(d, i): best(w.split(), x.split()) for d, x in table for i, w in bench}
    got = decontam.decontaminate(spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(bench + bench[:3], "item_id long, text string")).collect()
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got)
    found = {(r.doc_id, r.item_id): r.score for r in got}
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    texts = dict(table)
    for (d, i), score in true.items():
        n, w = len(items[i]), texts[d].split()
        enough = score >= max(0.5 * n, min(3, n))
        whole = min(n, decontam.WINDOW + 2)  # a copied run of as many words always holds a seed
        assert (d, i) not in found or enough and found[d, i] == score
        assert (d, i) in found or not (enough and runs(w, whole) & runs(items[i], whole))
    assert len(found) > 40


def test_rows_without_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    from ohlcraft.llm import bitmap

    monkeypatch.setattr(bitmap, "MOST", 1 << 15)
    d = spark.range(5000).selectExpr("id % 2000 AS id", "id AS __key0", "id % 7 AS __maybe")
    gone = spark.range(0, 2000, 3).selectExpr("id AS k")
    got = bitmap.without_rows(d, [F.col("id")], gone)
    assert got.columns == d.columns and sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in d.collect() if r.id % 3)
    assert bitmap.without_rows(d, [F.col("id")], gone.limit(0)).count() == 5000 and bitmap.without_rows(d.limit(0), [F.col("id")], gone).count() == 0


def docs_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_word_hashes_tell_words_apart():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcé漢0") for _ in range(rng.randint(1, 9))) for _ in range(3000)] + ["x" * 5000, "x" * 5001, "y" * 70_000, "z" * 4096, "z" * 4097]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(50)] + [" ".join(words), "", "  .,;", "Aa aA\taa\naa,aa", " ".join(["w"] * 70_000) + " tail"]
    seen = {}
    for text in texts:
        cut, h = decontam.words_of(text), decontam.word_hashes(text).tolist()
        assert len(cut) == len(h) and all(x >= 0 for x in h)
        for w, x in zip(cut, h, strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen) > 2000


def test_smith_waterman_against_loops():
    rng = random.Random(8)
    for _ in range(30):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        score, _ = decontam.align([np.array(a), np.array([9])], [np.array(b), np.array([8, 9])])
        assert score.tolist() == [max(map(max, h)), 1]


def test_flat_graph(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 16))
    near = base[:60].repeat(6, axis=0) + rng.normal(size=(360, 16)) * 0.12
    x = np.concatenate([base, near, near[:50], base[:1].repeat(40, axis=0), base[1:2] * 3]).astype(np.float32)
    table = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    n = len(table)
    odd = [None, [], [0.0] * 16, [1.0] * 15 + [float("nan")], [1.0] * 15 + [None], [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0]]
    table += [(n + i, v, "c") for i, v in enumerate(odd)] + [(None, x[0].tolist(), "c")]
    got = {r.vec_id: r for r in flat_graph.near_duplicate_vectors(spark.createDataFrame(table, "vec_id long, embedding array<float>, rep string")).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    comp = components_of(range(n), [(int(a), int(b)) for a, b in zip(*np.nonzero(linked), strict=True)])
    true = linked.sum(axis=1) - 1
    assert sum(got[i].n_links for i in range(n)) >= 0.99 * true.sum() and all(got[i].n_links <= true[i] for i in range(n))
    assert sum(got[i].component_id == comp[i] for i in range(n)) >= 0.99 * n
    for i in range(n, n + 6):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[n + 6].n_links == 1 and got[n + 7].component_id == n + 6 and got[None].component_id is None
    assert flat_graph.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def _more_vectors(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    return v.unionByName(v.selectExpr("vec_id + 10000 AS vec_id", "transform(embedding, (x, i) -> cast(x + 0.02 * sin(vec_id * 31 + i * 17) AS float)) AS embedding", "label"))


@pytest.mark.parametrize("limits", [{"CAP": 100}, {"SHARD": 32, "FAN": 4, "CAP": 100, "SLICE": 50, "SAMPLE": 200}])
def test_flat_graph_recall_and_hot_shards(spark, monkeypatch, limits):
    """Blocks within hot shards; a tree of several levels, with queries dealt out in slices."""
    for k, x in limits.items():
        monkeypatch.setattr(flat_graph, k, x)
    v = _more_vectors(spark)
    found = flat_graph.near_duplicate_vectors(v).cache()
    got = flat_graph.audit_recall(v, found, every=5).first()
    assert got.links > 50 and got.surplus == 0 and got.recall >= 0.97


def test_flat_graph_crowd_over_many_shards(spark, monkeypatch):
    """A crowd of near copies larger than several shards keeps all its links."""
    for k, x in {"SHARD": 32, "FAN": 4, "CAP": 60}.items():
        monkeypatch.setattr(flat_graph, k, x)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(200, 24)), rng.normal(size=(1, 24)) + 0.1 * rng.normal(size=(300, 24))])
    found = flat_graph.near_duplicate_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= 0.95).sum(axis=1) - 1
    got = np.array([r.n_links for r in sorted(found, key=lambda r: r.vec_id)])
    assert (got <= true).all() and got.sum() >= 0.99 * true.sum() and len({r.component_id for r in found}) == 201


def test_flat_graph_keeps_doubles(spark):
    """Two vectors that only doubles tell apart are on the two sides of the bound."""
    c = 0.95
    table = [(0, [1.0, 0.0]), (1, [c + 1e-10, (1 - (c + 1e-10) ** 2) ** 0.5]), (2, [c - 1e-10, -((1 - (c - 1e-10) ** 2) ** 0.5)])]
    got = flat_graph.near_duplicate_vectors(spark.createDataFrame(table, "vec_id long, embedding array<double>")).orderBy("vec_id").collect()
    assert [(r.n_links, r.component_id) for r in got] == [(1, 0), (1, 0), (0, 2)]


def test_flat_graph_audit_sees_lost_and_false_links(spark):
    table = [(0, [1.0, 0.0]), (100, [1.0, 0.01]), (200, [0.0, 1.0]), (300, [1.0, 2.0, 3.0]), (400, None), (500, [0.0])]
    v = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    found = spark.createDataFrame([(0, 0), (100, 1), (200, 5), (300, 0), (400, 0), (500, 0)], "vec_id long, n_links long")
    got = flat_graph.audit_recall(v, found).first()
    assert (got.audited, got.links, got.missed, got.surplus, got.recall) == (4, 2, 1, 5, 0.5)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies</div>
<%(tag)s><h1>Title %(n)d &amp; more</h1><p>First  para
 of <b>page</b> %(n)d<p>Second <i>one</i> &lt;x&gt; %(n)d<ul><li>item a%(n)d<li>item b%(n)d</ul><div class="advert">Buy</div><script>var a="</p>";</script></%(tag)s>
<div id="comments"><p>Reader says %(n)d</p></div><aside>Side</aside><footer>&copy; site</footer></body></html>"""


def test_html(spark):
    want = lambda n: f"Title {n} & more\nFirst para of page {n}\nSecond one <x> {n}\nitem a{n}\nitem b{n}"
    table = [(n, f"https://{'a.org' if n % 3 else 'b.org:80'}/p{n}", PAGE % {"n": n, "tag": "article" if n % 3 else "div"}, "x") for n in range(40)]
    table += [(100, None, None, "x"), (101, "nonsense", "", "x"), (102, "https://c.org/", "just text", "x"), (103, "https://d.org/", "<p>un<b>closed <!-- no end", "x"), (None, "https://a.org/p1", table[1][2], "x"), (1, "https://a.org/p1", table[1][2], "x")]
    table += [(104, "https://e.org/", "<div>" * 3000 + "deep" + "<p " * 500, "x")]
    got = html_template.extract_text(spark.createDataFrame(table, "page_id long, url string, html string, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    for n in range(40):
        assert by[n][0] == want(n), (n, by[n])
    assert by[100] == [""] and by[101] == [""] and by[102] == ["just text"] and by[103] == ["unclosed"] and by[None] == [want(1)] and len(by[1]) == 2
    assert html_template.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_templates_own_words_are_left_out(spark):
    page = "<html><body><div class=top><p>Welcome to the site</p></div><div class=body><p>%s</p><p>Rated by our editors</p><p>%s</p></div></body></html>"
    table = [(n, f"http://h.org/{n}", page % (f"alpha {n} " + "word " * 30, f"beta {n} " + "word " * 30)) for n in range(9)]
    got = html_template.extract_text(spark.createDataFrame(table, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {n: f"alpha {n} " + " ".join(["word"] * 30) + f"\nbeta {n} " + " ".join(["word"] * 30) for n in range(9)}


@pytest.mark.parametrize("n", [2, 25])
def test_html_copies_of_one_page_keep_their_text(spark, n):
    kinds = {"article": "<article><p>one para</p><p>two para</p></article>", "main": "<main><p>one para</p><p>two para</p></main>", "div": "<div><p>one para</p><p>two para</p></div>"}
    table = [(i, None if k == "div" else f"http://{k}.org/{i}", f"<html><body><nav>Menu</nav>{b}</body></html>") for k, b in kinds.items() for i in range(n)]
    # not quite copies: they differ in what isn't text
    table += [(i, f"http://near-{k}.org/{i}", f"<html><body><!-- {i} -->{b}</body></html>") for k, b in kinds.items() for i in range(n)]
    got = html_template.extract_text(spark.createDataFrame(table, "page_id long, url string, html string")).collect()
    assert len(got) == len(table) and {r.text for r in got} == {"one para\ntwo para"}


@pytest.mark.parametrize("tag", ["article", "main"])
def test_html_site_words_inside_the_article(spark, tag):
    body = lambda n: f"alpha {n} " + " ".join(["word"] * 30)
    page = f"<html><body><{tag}><p>Read our house rules</p><section><p>%s</p></section><em>Rated by our editors</em></{tag}></body></html>"
    table = [(n, f"http://h.org/{n}", page % body(n)) for n in range(4)]
    # near copies: what they share is the article
    table += [(10 + n, f"http://n.org/{n}", f"<html><body><{tag}><h1>{body(0)}</h1><section>page {n}</section></{tag}></body></html>") for n in range(2)]
    got = {r.page_id: r.text for r in html_template.extract_text(spark.createDataFrame(table, "page_id long, url string, html string")).collect()}
    assert got == {n: body(n) for n in range(4)} | {10 + n: f"{body(0)}\npage {n}" for n in range(2)}


def _one(html_text, others=()):
    """A page's text alone, and with the template of itself and others on one host."""
    alone = html_template.page_text(html_text, -1, frozenset())
    tokens, pages = _loops([html_text, *others])
    root, own = html_template.article_slot(tokens, len(pages))
    return alone, html_template.page_text(html_text, root, own)


def _loops(pages):
    """(template tokens with whole occurrence vectors, distinct pages) by plain loops."""
    pages = sorted(set(pages))
    table = {}
    for i, page in enumerate(pages):
        for token, up, tag, marked, bad, n, chars, links in html_template.page_tokens(page):
            t = table.setdefault(token, {"token": token, "parent": up, "tag": tag, "marked": marked, "boilerplate": bad, "times": 0, "chars": 0, "links": 0, "vec": [0] * len(pages), "pages": 0})
            t["vec"][i] = n
            t["pages"] += 1
            t["times"] += n
            t["chars"] += chars
            t["links"] += links
    least = max(2, html_template.SUPPORT * len(pages)) if len(pages) > 1 else 1
    found = [dict(t, vec=tuple(t["vec"])) for _, t in sorted(table.items()) if t["pages"] >= least]
    return found, pages


def test_html_template_equals_loops_over_whole_vectors(spark):
    """The deduced slot and own words of every host, against explicit vectors; repeated rows change nothing."""
    hosts, rows = {}, []
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        hosts.setdefault((r.url or "").split("://")[-1].split("/")[0].lower(), []).append(r.html or "")
    for k, tag in enumerate(("article", "div", "section")):
        hosts[f"t{k}.org"] = [f"<body><div class=top>Welcome</div><{tag}><h2>H {n}</h2><p>Site rules</p>{'<p>text %d</p>' % n * (n % 3 + 9)}</{tag}><div><p>{'odd' if n % 2 else 'even'}</p></div></body>" for n in range(7)]
    for h, pages in hosts.items():
        rows += [(f"http://{h}/x", p) for p in pages]
    rows += rows[::3] + rows[::5]
    got = {r.host: r for r in html_template.deduce_templates(spark.createDataFrame(rows, "url string, html string")).collect()}
    for h, pages in hosts.items():
        tokens, distinct = _loops(pages)
        if len(distinct) < 2:
            assert h not in got
            continue
        root, own = html_template.article_slot(tokens, len(distinct))
        assert (got[h].root, got[h].own) == (root, sorted(own)), h
    assert got["t0.org"].own and got["t1.org"].own


def test_html_classes_nest_by_slots():
    pages = [f"<body><nav><a>Home</a></nav><div><h1>T{n}</h1><ul>{'<li><p>k</p><p>v%d</p></li>' % n * (n + 2)}</ul></div></body>" for n in range(4)]
    tokens, _ = _loops(pages)
    parent, slot, own = html_template.nest(tokens)
    by = {t["token"]: t for t in tokens}
    name = {by[s]["tag"]: s for s in parent}
    ones = (1, 1, 1, 1)
    assert {t for t, s in name.items() if slot[s] == (ones, 0)} == {"body", "nav", "a", "div", "h1", "ul"}
    assert slot[name["li"]] == ((2, 3, 4, 5), name["ul"]) and slot[name["p"]] == ((4, 6, 8, 10), name["li"])  # classes of their own, slot in slot
    assert {by[o]["vec"] for o in own} == {ones, (2, 3, 4, 5)}  # "Home", and "k" in every item


@pytest.mark.parametrize("depth", [7, 70, 700])
def test_html_slots_at_any_depth(depth):
    pages = [f"<body><p>stray {n}</p>" + "<div>" * depth + f"<section><h1>T {n}</h1><p>{'story %d ' % n * 9}</p></section>" + "</div>" * depth + "</body>" for n in range(6)]
    for text in _one(pages[3], pages):
        assert text == "T 3\n" + " ".join(["story 3"] * 9)


def test_html_long_attributes_and_stray_quotes():
    for size in (150, 15_000, 150_000):
        for text in _one(f"<article><p data-x=\"{'a>b ' * (size // 4)}\">one</p><p title='{'x' * size}' it's>two <img alt='>'>more</p></article>"):
            assert text == "one\ntwo more"
    assert _one("<article><p class=\"open>text</p></article>")[0].startswith("text")


def test_html_embedded_content_stays():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p><p><object data=a>old <b>way</b></object> <audio>sound</audio> <video>film</video> <canvas>drawing</canvas> a<wbr>b</p></article>"
    for text in _one(page):
        assert text == "Let x=1 be\nold way sound film drawing ab"


def test_html_names_of_paragraphs_and_headings_decide_nothing():
    page = "<body><article><h1 class='post-header'>Head</h1><p class='social-history'>One</p><p id='related-work'>Two</p><div class='related-work'>Three</div><div class='ad-slot-3'>Buy</div><section id='comments'><p>Reader</p></section><div role='navigation'>Menu</div></article></body>"
    for text in _one(page, [page.replace("One", f"One {n}") for n in range(5)]):
        assert text == "Head\nOne\nTwo\nThree"


def test_html_comments_longer_than_the_article():
    pages = [f"<body><div class=wrap><div class=post><p>{'news %d ' % n * 20}</p></div><div class='comment-list'>{'<p>reader %d says much</p>' % n * 30}</div></div><div>{'Terms and conditions. ' * 40}</div></body>" for n in range(5)]
    assert _one(pages[2], pages)[1] == " ".join(["news 2"] * 20)


def test_licenses(spark, docs, empty):
    """A real tree of paths, against a walk up each path."""
    mit, apache, ccnc = "MIT License\n\nReleased under the MIT License.", "Licensed under the Apache License, Version 2.0.", "// Licensed under CC BY-NC 4.0.\nbody of words"
    table = [
        ("a/LICENSE", mit, 0), ("a/b/c/x.py", "# code\nprint(1)", 1), ("a/b/COPYING.txt", apache, 2), ("a/b/c/d/y.py", "nothing", 3), ("z/q.py", ccnc, 4), ("z/r.py", "body", 5), ("a/n.py", None, 6),
        (None, "Released under the MIT License.", 7), ("a/bc/x.py", "text", 8), ("a/n.py", None, 6), ("k/LICENSE", ccnc, 9), ("k/LICENCE.md", mit, 9), ("k/x", "", 9), ("u/LICENSE", "Licensed under the Foo Open Public License, Version 2.0 of today.", 9), ("u/x", "", 9), ("top.py", "", 9),
    ]
    got = {r.path: r for r in licenses.scan_licenses(spark.createDataFrame(table, "path string, text string, license long")).collect()}
    files = {p: got[p].own_license for p, _, _ in table if p and p.split("/")[-1].split(".")[0].upper() in ("LICENSE", "LICENCE", "COPYING") and got[p].own_license}
    for path, _, _ in table:
        if path is None:
            continue
        want, at = (got[path].own_license, path if got[path].own_license else None), path.split("/")[:-1]
        while want[0] is None:
            near = sorted(p for p in files if p.split("/")[:-1] == at)
            if near:
                want = (files[near[0]], near[0])
            if not at:
                break
            at = at[:-1]
        assert (got[path].license, got[path].license_path) == want, path
    assert [got[p].license for p in ("a/b/c/d/y.py", "a/n.py", "a/bc/x.py", "k/x", "u/x", "z/r.py", "top.py")] == ["Apache-2.0", "MIT", "MIT", "MIT", "unknown", None, None]
    assert got[None].own_license == "MIT" and got[None].license == "MIT"
    assert licenses.scan_documents(docs).count() == len(rows()) and licenses.scan_documents(empty).count() == 0


_APACHE_1_1 = """/* ====================================================================
 * The Apache Software License, Version 1.1
 *
 * Copyright (c) 2000 The Apache Software Foundation.  All rights
 * reserved.
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met: */"""


def _commented(text, sign, width=60):
    import textwrap

    return "int x;\n" + "\n".join(f"{sign} {line}" for line in textwrap.wrap(text, width)) + "\nreturn some words of a program with version 3 and license keys\n"


def test_licenses_of_headers_and_versions():
    scorer = licenses.Scorer(licenses.TEMPLATES, {}, 0)
    for sign in ("#", " *", "//", "--"):
        for name, version, want in (("General Public", "2", "GPL-2.0"), ("General Public", "3", "GPL-3.0"), ("Lesser General Public", "2.1", "LGPL-2.1"), ("Lesser General Public", "3", "LGPL-3.0"), ("Affero General Public", "3", "AGPL-3.0")):
            assert scorer.scan(_commented(licenses._gnu(f"GNU {name} License", version), sign))[1:] == (want, 1)
    for words, want in (("Attribution-NoDerivatives 4.0", "CC-BY-ND-4.0"), ("Attribution 4.0", "CC-BY-4.0"), ("Attribution 3.0", "unknown"), ("Attribution-Foobar 4.0", "unknown")):
        assert scorer.scan(f"x y. This work is licensed under a Creative Commons {words} International License. z")[1] == want
    assert scorer.scan(_APACHE_1_1)[1] == "Apache-1.1"
    assert scorer.scan(licenses._MIT + licenses._MIT_END)[1] == "MIT" and scorer.scan(_commented(licenses.TEMPLATES["Apache-2.0"][2], "#"))[1] == "Apache-2.0"
    assert scorer.scan("Licensed under the Foo Open Public License, Version 2.0 of today.")[1] == "unknown"
    assert scorer.scan("they all have rights; one is reserved for the licensed few")[1] is None and scorer.scan("")[1] is None
    edited = licenses._gnu("GNU General Public License", "2").replace("useful", "of use").replace("hope", "hopes")
    assert scorer.scan(edited)[1] == "GPL-2.0"


def test_licenses_long_lines_and_ties():
    tied = {"B": ("one two three four five six seven eight nine",), "A": ("one two three four five six seven eight nine",), "C": ("this is quite another notice",)}
    scorer = licenses.Scorer(tied, {}, 0)
    assert scorer.scan("one two three four five six seven eight nine")[1] == "unknown"  # as near to two
    filler = "word " * 50_000
    assert scorer.scan(filler + "this is quite another notice " + filler + "\n" + "x" * 300_000)[1:] == ("C", 0)


def test_license_cosine_by_loops():
    """The best cosine of a template over all windows of its length, taken one by one."""
    rng = np.random.default_rng(4)
    counts = {w: int(rng.integers(0, 50)) for w in licenses._vocabulary(licenses.TEMPLATES)}
    scorer = licenses.Scorer(licenses.TEMPLATES, counts, 60)
    texts = ["foo " + t + " bar" for ts in licenses.TEMPLATES.values() for t in ts][::5]

    def terms(words):
        out = {}
        for k in [(w,) for w in words] + list(zip(words, words[1:], strict=False)):
            out[k] = out.get(k, 0) + max(scorer.idf.get(w, scorer.other) for w in k)
        return out

    for text in texts:
        words = licenses.words_of(text)
        best = 0.0
        for ts in licenses.TEMPLATES.values():
            for t in ts:
                a = terms(licenses.words_of(t))
                n = len(licenses.words_of(t))
                for p in range(max(1, len(words) - n + 1)):
                    b = terms(words[p : p + n])
                    dot = sum(x * b.get(k, 0) for k, x in a.items())
                    best = max(best, dot / (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5)
        assert abs(scorer.best(words)[0] - best) < 1e-9 and scorer.best(words)[1] is not None


def _one(html_text, others=()):
    """A page's text alone, and with the template of itself and others on one host."""
    alone = html_template.page_text(html_text, -1, frozenset())
    tokens, pages = _loops([html_text, *others])
    root, own = html_template.article_slot(tokens, len(pages))
    return alone, html_template.page_text(html_text, root, own)


def _loops(pages):
    """(template tokens with whole occurrence vectors, distinct pages) by plain loops."""
    pages = sorted(set(pages))
    table = {}
    for i, page in enumerate(pages):
        for token, up, tag, marked, bad, n, chars, links in html_template.page_tokens(page):
            t = table.setdefault(token, {"token": token, "parent": up, "tag": tag, "marked": marked, "boilerplate": bad, "times": 0, "chars": 0, "links": 0, "vec": [0] * len(pages), "pages": 0})
            t["vec"][i] = n
            t["pages"] += 1
            t["times"] += n
            t["chars"] += chars
            t["links"] += links
    least = max(2, html_template.SUPPORT * len(pages)) if len(pages) > 1 else 1
    found = [dict(t, vec=tuple(t["vec"])) for _, t in sorted(table.items()) if t["pages"] >= least]
    return found, pages


def test_html_template_equals_loops_over_whole_vectors(spark):
    """The deduced slot and own words of every host, against explicit vectors; repeated rows change nothing."""
    hosts, rows = {}, []
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        hosts.setdefault((r.url or "").split("://")[-1].split("/")[0].lower(), []).append(r.html or "")
    for k, tag in enumerate(("article", "div", "section")):
        hosts[f"t{k}.org"] = [f"<body><div class=top>Welcome</div><{tag}><h2>H {n}</h2><p>Site rules</p>{'<p>text %d</p>' % n * (n % 3 + 9)}</{tag}><div><p>{'odd' if n % 2 else 'even'}</p></div></body>" for n in range(7)]
    for h, pages in hosts.items():
        rows += [(f"http://{h}/x", p) for p in pages]
    rows += rows[::3] + rows[::5]
    got = {r.host: r for r in html_template.deduce_templates(spark.createDataFrame(rows, "url string, html string")).collect()}
    for h, pages in hosts.items():
        tokens, distinct = _loops(pages)
        if len(distinct) < 2:
            assert h not in got
            continue
        root, own = html_template.article_slot(tokens, len(distinct))
        assert (got[h].root, got[h].own) == (root, sorted(own)), h
    assert got["t0.org"].own and got["t1.org"].own


def test_html_classes_nest_by_slots():
    pages = [f"<body><nav><a>Home</a></nav><div><h1>T{n}</h1><ul>{'<li><p>k</p><p>v%d</p></li>' % n * (n + 2)}</ul></div></body>" for n in range(4)]
    tokens, _ = _loops(pages)
    parent, slot, own = html_template.nest(tokens)
    by = {t["token"]: t for t in tokens}
    name = {by[s]["tag"]: s for s in parent}
    ones = (1, 1, 1, 1)
    assert {t for t, s in name.items() if slot[s] == (ones, 0)} == {"body", "nav", "a", "div", "h1", "ul"}
    assert slot[name["li"]] == ((2, 3, 4, 5), name["ul"]) and slot[name["p"]] == ((4, 6, 8, 10), name["li"])  # classes of their own, slot in slot
    assert {by[o]["vec"] for o in own} == {ones, (2, 3, 4, 5)}  # "Home", and "k" in every item


@pytest.mark.parametrize("depth", [7, 70, 700])
def test_html_slots_at_any_depth(depth):
    pages = [f"<body><p>stray {n}</p>" + "<div>" * depth + f"<section><h1>T {n}</h1><p>{'story %d ' % n * 9}</p></section>" + "</div>" * depth + "</body>" for n in range(6)]
    for text in _one(pages[3], pages):
        assert text == "T 3\n" + " ".join(["story 3"] * 9)


def test_html_long_attributes_and_stray_quotes():
    for size in (150, 15_000, 150_000):
        for text in _one(f"<article><p data-x=\"{'a>b ' * (size // 4)}\">one</p><p title='{'x' * size}' it's>two <img alt='>'>more</p></article>"):
            assert text == "one\ntwo more"
    assert _one("<article><p class=\"open>text</p></article>")[0].startswith("text")


def test_html_embedded_content_stays():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p><p><object data=a>old <b>way</b></object> <audio>sound</audio> <video>film</video> <canvas>drawing</canvas> a<wbr>b</p></article>"
    for text in _one(page):
        assert text == "Let x=1 be\nold way sound film drawing ab"


def test_html_names_of_paragraphs_and_headings_decide_nothing():
    page = "<body><article><h1 class='post-header'>Head</h1><p class='social-history'>One</p><p id='related-work'>Two</p><div class='related-work'>Three</div><div class='ad-slot-3'>Buy</div><section id='comments'><p>Reader</p></section><div role='navigation'>Menu</div></article></body>"
    for text in _one(page, [page.replace("One", f"One {n}") for n in range(5)]):
        assert text == "Head\nOne\nTwo\nThree"


def test_html_comments_longer_than_the_article():
    pages = [f"<body><div class=wrap><div class=post><p>{'news %d ' % n * 20}</p></div><div class='comment-list'>{'<p>reader %d says much</p>' % n * 30}</div></div><div>{'Terms and conditions. ' * 40}</div></body>" for n in range(5)]
    assert _one(pages[2], pages)[1] == " ".join(["news 2"] * 20)


def test_licenses(spark, docs, empty):
    table = [
        ("a/LICENSE", "MIT License\n\nReleased under the MIT License.", 0), ("a/b/c/x.py", "# code\nprint(1)", 1), ("a/b/COPYING.txt", "Licensed under the Apache License, Version 2.0.", 2),
        ("a/b/c/d/y.py", "nothing", 3), ("z/q.py", "// Licensed under CC BY-NC 4.0.\nbody of words", 4), ("z/r.py", "body", 5), ("a/n.py", None, 6), (None, "Released under the MIT License.", 7), ("a/bc/x.py", "text", 8), ("a/n.py", None, 6),
    ]
    got = {r.path: r for r in licenses.scan_licenses(spark.createDataFrame(table, "path string, text string, license long")).collect()}
    assert [(got[p].own_license, got[p].license, got[p].license_path) for p in ("a/b/c/x.py", "a/b/c/d/y.py", "z/q.py", "z/r.py", "a/n.py", "a/bc/x.py")] == [
        (None, "Apache-2.0", "a/b/COPYING.txt"), (None, "Apache-2.0", "a/b/COPYING.txt"), ("CC-BY-NC-4.0", "CC-BY-NC-4.0", "z/q.py"), (None, None, None), (None, "MIT", "a/LICENSE"), (None, "MIT", "a/LICENSE"),
    ]
    assert got[None].own_license == "MIT" and got[None].license == "MIT"
    assert licenses.scan_documents(docs).count() == len(rows()) and licenses.scan_documents(empty).count() == 0


def test_html_decoding_matches_library():
    blocks, _ = html_template.parse("<p>a&nbsp;b &#x41;&amp;amp; &am &copy</p>")
    assert blocks[0][0] == " ".join(html.unescape("a&nbsp;b &#x41;&amp;amp; &am &copy").split())
