"""Binary records, fill-in-middle forms and ranked search against brute force."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spikeloom.llm import fim, lexical, packing, pii, token_records

DOC = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, "word other " * 30_000), (4, "a b c d e\nf g h i j k"), (4, "a b c d e\nf g h i j k"), (None, "no id here\nbut some words"), (5, " \t\n "), (6, "has <S> in it\nand more\n"), (-7, "é日😀\n\n\nx")]
    return spark.createDataFrame(rows, DOC).select("doc_id", "text", *[F.lit("x").alias(c) for c in ("ids", "n", "form", "start", "score", "rank", "query", "terms", "sizes", "_tie")])


# -- 11


def slow_crc32c(data):
    crc = 0xFFFFFFFF
    for x in data:
        crc ^= x
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


@given(st.lists(st.binary(max_size=1500), max_size=6))
@settings(max_examples=40, deadline=None)
def test_checksums(parts):
    assert token_records.crc32c(parts).tolist() == [slow_crc32c(p) for p in parts]
    assert token_records.crc32c([b"123456789"])[0] == 0xE3069283


def walked(path):
    """The records of a data file, read as the format says, with nothing but struct."""
    data, at = path.read_bytes(), 0
    mask = lambda crc: (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF
    while at < len(data):
        n, head = struct.unpack_from("<QI", data, at)
        assert head == mask(slow_crc32c(data[at : at + 8]))
        payload = data[at + 12 : at + 12 + n]
        if n < 400:
            assert struct.unpack_from("<I", data, at + 12 + n)[0] == mask(slow_crc32c(payload))
        width, known, doc_id = struct.unpack_from("<BB6xq", payload)
        yield at, n, doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=16).tolist()
        at += 16 + n


def test_records(spark, odd, tmp_path):
    path = f"file://{tmp_path}/records"
    got = token_records.output(odd, path, files=3).collect()
    whole = packing.tokenizer(packing.default_vocabulary()).tokenizer
    expected = sorted(((r.doc_id, whole.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in odd.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    start = 0
    assert len(got) == len(expected)
    for r, (doc_id, ids) in zip(sorted(got, key=lambda r: r.start), expected):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    files = sorted((tmp_path / "records").glob("*.records"))
    seen = []
    for file in files:
        index = np.frombuffer(file.with_suffix(".index").read_bytes(), "<u8").reshape(-1, 3).tolist()
        before = 0
        for (at, n, doc_id, ids), entry in zip(walked(file), index, strict=True):
            assert entry == [at, n, before]
            before += len(ids)
            seen.append((doc_id, ids))
    assert seen == expected


def test_permuted_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_records, "READ_RECORDS", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = str(tmp_path / "records")
    token_records.write(docs, path)
    plain = {r.record: r.ids for r in token_records.read(spark, path).collect()}
    assert sorted(plain) == list(range(docs.count()))
    orders = []
    for seed in (1, 1, 2):
        rows = token_records.read(spark, path, seed).collect()
        assert {r.record: r.ids for r in rows} == plain
        orders.append([r.record for r in rows])
    assert orders[0] == orders[1] != orders[2] and orders[0] != sorted(orders[0])
    assert all(sorted(token_records.permuted(np.arange(n), n, 3).tolist()) == list(range(n)) for n in (1, 2, 3, 17, 1000))


def test_broken_files_and_empty_tables(spark, odd, tmp_path):
    path = tmp_path / "records"
    token_records.write(odd, str(path), files=1)
    (file,) = path.glob("*.records")
    data = bytearray(file.read_bytes())
    data[30] ^= 1
    file.write_bytes(data)
    with pytest.raises(Exception, match="broken"):
        token_records.read(spark, str(path)).collect()
    assert token_records.output(odd.limit(0), str(tmp_path / "none")).count() == 0
    many = np.arange(70_000, dtype="<u4")
    assert token_records.unpack_record(token_records.pack_record(None, many))[1].tolist() == many.tolist()


def test_files_of_attempts_that_failed_are_not_read(spark, odd, tmp_path):
    path = tmp_path / "records"
    token_records.write(odd, str(path), files=2)
    before = token_records.read(spark, str(path)).count()
    (path / "000000-99.records").write_bytes(b"half a record")
    assert token_records.read(spark, str(path)).count() == before


# -- 12


@given(st.text(alphabet="ab \n\té日😀", max_size=60))
@settings(max_examples=200, deadline=None)
def test_units(text):
    for name, pattern in (("line", r"[^\n]*\n|[^\n]+"), ("word", r"[\t-\r ]+(?=[^\t-\r ])|[^\t-\r ]+[\t-\r ]*|[\t-\r ]+")):
        units = re.findall(pattern, text)
        mask = fim.UNITS[name](text)
        assert mask.bit_count() == len(units)
        at = 0
        for k, unit in enumerate(units):
            assert fim.select(mask, k, len(text)) == at
            at += len(unit)


def by_hand(doc_id, text, seed=7, rate=100, spm_rate=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or c % 100 >= rate:
        return n, "plain", None, None, text
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    prefix, middle, suffix = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if d % 100 < spm_rate:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@given(st.integers(0, 10**9), st.text(alphabet="a<PSM> \né😀", max_size=80), st.sampled_from([0, 40, 100]))
@settings(max_examples=300, deadline=None)
def test_forms(doc_id, text, rate):
    got = fim.turn(text, doc_id, 7, rate, 50)
    assert got == by_hand(doc_id, text, rate=rate)
    assert fim.restore(got[4], got[1]) == text


def test_fill_in_middle_small_cases(spark, odd):
    rows = {(r.doc_id, r.text): r for r in odd.select("doc_id", "text").collect()}
    turned = fim.transform(odd, seed=7, rate=100, spm_rate=50)
    got = turned.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == 9 and sorted(r.back for r in got) == sorted(t or "" for _, t in list(rows) + [(4, rows[(4, "a b c d e\nf g h i j k")].text)])
    for r in got:
        text = r.back
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand("" if r.doc_id is None else r.doc_id, text)
    assert {r.form for r in got if r.doc_id in (1, 2, 6)} == {"plain"}
    assert fim.transform(odd.limit(0)).count() == 0


# -- 13


def ranked_by_hand(docs, items, k=20):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    words = lambda t: term.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    held = [(d, Counter(words(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in held:
            m = 75 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("postings", [40, 400, 1 << 20])
def test_ranking_matches_brute_force(spark, monkeypatch, postings):
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(lexical, "PILOT", 3)
    rng = random.Random(postings)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ß", "日本", "A1b"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(300)] + [(5, "w0 w1"), (5, "w0 w1"), (None, "w3 W3 w50"), (9000, None), (9001, "w1 " * 5000)]
    items = [(i, text(rng.randint(0, 12))) for i in range(25)] + [(3, "w50 w50"), (None, "w2"), (77, None), (78, "nowhere")]
    found = lexical.search(spark.createDataFrame(docs, DOC).repartition(4), spark.createDataFrame(items, "item_id long, text string"), k=7)
    assert rows(found) == sorted(ranked_by_hand(docs, items, 7), key=repr)


def test_queries_in_groups(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_CHARS", 30)
    docs = [(i, f"a b{i % 3} c{i % 5}") for i in range(40)]
    items = [(i, f"b{i % 3} c{i % 5}") for i in range(12)]
    found = lexical.search(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(found) == sorted(ranked_by_hand(docs, items), key=repr)


def test_search_small_cases(spark, odd):
    items = spark.createDataFrame([(1, "word"), (2, "f g nothing"), (3, "")], "item_id long, text string").withColumn("score", F.lit(1))
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert rows(lexical.search(odd, items)) == sorted(ranked_by_hand(docs, [(1, "word"), (2, "f g nothing"), (3, "")]), key=repr)
    assert lexical.search(odd.limit(0), items).count() == 0
    assert lexical.search(odd, items.limit(0)).count() == 0


def test_the_walk_stops_early_where_impacts_differ():
    """A few documents stand out, so most postings of the common term are never walked."""
    n = 4000
    sizes = np.full(n, 100)
    terms, docs, tfs = ["common", "rare"], np.concatenate([np.arange(n), np.arange(30)]), np.concatenate([np.ones(n), np.full(30, 9)])
    block = lexical.Impacts(sizes, terms, np.array([n, n + 30]), docs.astype("int32"), tfs.astype("int32"), n, 100 * n)
    work = [0, 0]
    places, scores = lexical.best_of_block(block, [("common", 5), ("rare", 4000)], 1, 20, work)
    assert places.tolist() == list(range(20)) and len(set(scores.tolist())) == 1 and work[0] < 0.05 * work[1]


# -- texts that once failed


def test_a_million_white_space_characters(spark):
    t = packing.tokenizer(packing.default_vocabulary())
    texts = [" " * 1_000_000, "\n" * 1_000_000 + "x", "a" + "\t" * 1_000_001, " \n" * 500_000]
    whole = [t.tokenizer.encode(s, add_special_tokens=False).ids for s in texts]
    for s, ids in zip(texts, whole):
        assert t.encode(s).tolist() == ids
    packed = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), DOC)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == {i: len(ids) + 1 for i, ids in enumerate(whole)}


def test_secrets_of_any_length(spark):
    rng = random.Random(3)
    secrets = {n: "".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (40, 300, 600, 10_000)}
    texts = [f'the token = "{s}" is here' for s in secrets.values()] * 10 + ["plain words without anything"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    got = {r.doc_id: r for r in pii.detect(docs).collect()}
    for i, s in enumerate(secrets.values()):
        at = texts[i].index(s)
        assert f"secret:{at}:{at + len(s)}" in got[i].spans.split(",")
    redact = pii.redactor(pii.learn(docs))
    assert not any(s[:30] in r.text for r in docs.select(redact("text").alias("text")).collect() for s in secrets.values())


def test_key_markers_in_any_order():
    lazy = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]*?-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----")
    rng = random.Random(1)
    parts = ["-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----END PRIVATE KEY-----", "abc\n", "!", "-", "-----END ", "A9/+"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert pii._private_keys(text) == [m.span() for m in lazy.finditer(text)]
    for text in ("-----BEGIN PRIVATE KEY-----" * 20_000 + "-----END " * 20_000, "-----BEGIN PRIVATE KEY-----\n!" * 20_000 + "-----END PRIVATE KEY-----"):
        assert pii.loose_spans(text, []) in ([], [("secret", len(text) - 54, len(text))])


def test_base_spans_are_those_of_the_patterns():
    """The contract's patterns, applied plainly to random strings."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    good = {
        "email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "phone": lambda s: 8 <= len(digits(s)) <= 15,
        "card": lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)),
    }
    rng = random.Random(9)
    parts = ["a", "@", ".", "-", " ", "+", "1", "25", "4111 1111 1111 1111", "255.", "0.0", "x.yz", "(", "\n", "é"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        expected = [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, text) if good[k](m.group())]
        assert pii.base_spans(text) == expected


def test_a_task_reads_and_writes_the_index_a_block_at_a_time(spark, monkeypatch):
    """Three long documents in one file: a row group each, so that no task holds them all."""
    put, files = lexical.Shelf.put, []

    def spied(self, df, name, **options):
        table = put(self, df, name, **options)
        files.extend(table.inputFiles() if name == "index" else [])
        return table

    monkeypatch.setattr(lexical.Shelf, "put", spied)
    docs = spark.range(3).coalesce(1).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', sequence(id, id + 600000))").alias("text"))
    items = spark.createDataFrame([(1, "0 600002")], "item_id long, text string")
    assert [r.doc_id for r in lexical.search(docs, items).orderBy("rank").collect()] == [0, 2]
    kinds = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in files]
    assert sum(m.num_rows for m in kinds) == 3 == sum(m.num_row_groups for m in kinds)
