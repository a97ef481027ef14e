"""Each operator against a brute-force version, a round trip or held-out labels, and on odd tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import embeddings, minhash, packing, pii, quality, queries, secrets, sentencepiece_wfst, sharding, substring, toxicity
from tidelog.llm.kernels import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, "a b c d e f g h i j k l m n o p", "en", "x", 1), (1, "a b c d e f g h i j k l m n o p", "en", "x", 1), (2, "A b c d e f g h i j k l m n o p", "en", None, 2),
    (3, None, None, None, None), (4, "", "en", "x", 0), (5, " \t\n ", "en", "x", 3), (None, "a b c d e f g h i j k l m n o p", "en", "x", 5), (None, None, None, "x", None),
    (6, "password = 'Sup3rSecretValue!' ok mail me@site.org 4111 1111 1111 1111 é😀  x▁y <|endoftext|>", "en", "x", 9), (7, "wörd ünïcode " * 30000, "de", "x", 7), (8, "x" * 50000, "de", "x", 7), (9, "one", "en", "x", 3), (10, "one", "en", "x", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    extra = {c: F.lit(7) for c in ("node", "label", "shard", "kept", "n", "doc", "rank", "ids", "pii_spans", "words")}
    return spark.createDataFrame(ODD, SCHEMA).withColumns(extra)


@pytest.fixture(scope="module")
def docs(sf):
    return duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf}/documents.parquet') ORDER BY doc_id").fetchall()


def answers(spark, sf, name):
    return queries.queries()[name](spark, sf).collect()


def words(text):
    return WORD.findall(text or "")


def closure(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


ON_ODD = {
    "pii": lambda d: pii.pseudonymise(d, "k"),
    "sharding": sharding.shard_documents,
    "quality": quality.judge,
    "secrets": secrets.scan,
    "packing": packing.pack_documents,
    "minhash": minhash.near_duplicates,
    "sentencepiece": sentencepiece_wfst.encode,
    "substring": substring.remove_repeats,
    "toxicity": lambda d: toxicity.score(d, toxicity.fit_chain([], np.zeros(0))),
}


@pytest.mark.parametrize("name", ON_ODD)
def test_odd_and_empty_tables(odd, name):
    rows = ON_ODD[name](odd).collect()
    if name != "packing":
        assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ODD)
    assert ON_ODD[name](odd.limit(0)).collect() == []


def test_odd_results(odd):
    near = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd).collect()}
    assert near[2, 12] == (1, False) and near[1, 12] == (1, True) and near[10, 1] == (9, False) and near[4, 0] == (4, True) and near[None, 0] == (None, True) and near[None, 12] == (None, True)
    left = {(r["doc_id"], r["n_words"]): r for r in substring.remove_repeats(odd, carry=["lang"]).collect()}
    assert left[1, 16]["n_removed"] == 0 and left[2, 16]["n_removed"] == 15 and left[2, 16]["left_text"] == "A" and left[None, 16]["n_removed"] == 0 and left[2, 16]["lang"] == "en"
    assert left[3, 0]["left_text"] is None and left[5, 0]["left_text"] == " \t\n "


def test_words_kernel():
    texts = ["a  b\tc", "", "é😀 x"]
    data = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, data)])
    w = Words(off, np.frombuffer(b"".join(data), np.uint8))
    assert np.diff(w.first).tolist() == [3, 0, 2]


# pseudonyms


def test_pseudonyms_are_valid_and_can_be_undone():
    key = hashlib.sha256(b"k").digest()
    values = {"email": "joe.smith@mail.example.org", "iban": "DE89 3704 0044 0532 0130 00", "ip": "192.168.1.77", "date": "2024-02-29", "ssn": "123-45-6789", "phone": "+1-555-010-9999", "card": "4111-1111-1111-1111"}
    for kind, value in values.items():
        text = f"(see {value}, or {value})"
        new, spans = pii.replace(text, key)
        assert [s[0] for s in spans] == [kind, kind] and value not in new
        one, two = re.fullmatch(r"\(see (.*), or (.*)\)", new).groups()
        assert one == two and [c for c in one if not c.isalnum()] == [c for c in value if not c.isalnum()]
        assert pii.replace(new, key, back=True)[0] == text
        assert pii.replace(text, hashlib.sha256(b"other").digest())[0] != new
    assert pii.luhn(re.sub(r"\D", "", pii.pseudonym("card", "4111111111111111", key))) == 0
    assert pii.replace("4111111111111112 2023-02-29 300.1.1.1 000-12-3456 v1.2.3", key)[1] == []


def sampled(pattern, rng):
    """A text of the shape of ``pattern``; what stands around it (lookarounds) is left out."""
    from re import _constants as c
    from re import _parser

    groups = {}

    def one(op, arg):
        if op is c.LITERAL:
            return chr(arg)
        if op is c.IN:
            signs = [chr(x) for kind, v in arg for x in ([v] if kind is c.LITERAL else range(v[0], v[1] + 1))]
            return signs[rng.integers(len(signs))]
        if op is c.MAX_REPEAT:
            low, high, inner = arg
            return "".join(some(inner) for _ in range(rng.integers(low, min(high, low + 8) + 1)))
        if op is c.BRANCH:
            return some(arg[1][rng.integers(len(arg[1]))])
        if op is c.SUBPATTERN:
            groups[arg[0]] = some(arg[3])
            return groups[arg[0]]
        if op is c.GROUPREF:
            return groups[arg]
        assert op is c.ASSERT_NOT
        return ""

    def some(parts):
        return "".join(one(op, arg) for op, arg in parts)

    return some(_parser.parse(pattern))


def test_hint_is_implied_by_every_shape():
    import pyarrow as pa
    import pyarrow.compute as pc

    rng = np.random.default_rng(7)
    for kind, shape in pii._SHAPES.items():
        texts = [t for t in (sampled(shape, rng) for _ in range(3000)) if re.fullmatch(shape, t)]
        hint = pc.match_substring_regex(pa.array(texts), pii.HINT).to_pylist()
        assert len(texts) > 1000 and [t for t, h in zip(texts, hint, strict=True) if not h] == [], kind


def test_numbers_in_short_groups_are_replaced_in_any_text(spark):
    key = hashlib.sha256(b"k").digest()
    values = ["+33 6 12 34 56 78", "+45 12 34 56 78", "+47 22 33 44 55", "+49 89 636 480 18"]
    rows = [(2 * i + j, f"call {v} {more}") for i, v in enumerate(values) for j, more in enumerate(("now", "since 1999"))]
    got = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, text in rows:
        new, spans = pii.replace(text, key)
        assert len(spans) == 1 and got[i]["text"] == new != text and got[i]["pii_spans"] == f"phone:5:{5 + len(values[i // 2])}"


def test_permutation():
    for size in (1, 2, 3, 10, 97, 1000):
        got = [pii.permute(i, size, b"k", "t") for i in range(size)]
        assert sorted(got) == list(range(size)) and [pii.permute(v, size, b"k", "t", True) for v in got] == list(range(size))


def test_op1(spark, sf, docs):
    rows = {r["doc_id"]: r for r in answers(spark, sf, "op1_feistel_pseudonyms")}
    key = hashlib.sha256(queries.PII_KEY.encode()).digest()
    for i, text in docs:
        new, spans = pii.replace(text, key) if text else (text, [])
        assert rows[i]["text"] == new and rows[i]["pii_spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    assert sum(bool(r["pii_spans"]) for r in rows.values()) > 3


# sharding


def test_op2(spark, sf, docs):
    rows = answers(spark, sf, "op2_hash_tree_sharding")
    texts = {i: (t or "").encode() for i, t in docs}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        data = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "key") and r["grown_shard"] in (r["shard"], 40)
    assert set(by) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_weights_confine_movement(spark):
    ids = spark.range(20000).withColumnRenamed("id", "k")
    weights = [1.0] * 24
    changed = [*weights[:5], 3.0, *weights[6:]]
    both = sharding.assign(sharding.assign(ids, "k", weights, "a"), "k", changed, "b").collect()
    assert all(r["a"] == r["b"] or r["b"] == 5 for r in both)
    share = Counter(r["b"] for r in both)
    assert abs(share[5] / 20000 - 3 / 26) < 0.01 and all(abs(n / 20000 - 1 / 26) < 0.01 for s, n in share.items() if s != 5)
    emptied = sharding.assign(sharding.assign(ids, "k", weights, "a"), "k", [*weights[:5], 0.0, *weights[6:]], "b").collect()
    assert all(r["a"] == r["b"] or r["a"] == 5 for r in emptied) and not any(r["b"] == 5 for r in emptied)


# quality


def test_op3(spark, sf, docs):
    rows = {r["doc_id"]: r for r in answers(spark, sf, "op3_quality_cascade")}
    for i, text in docs:
        w, t = words(text), text or ""
        seen = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        repeated = {j + o for j in range(len(w) - 4) if seen[tuple(w[j : j + 5])] > 1 for o in range(5)}
        lines = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        expected = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), failed)
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == expected
        assert not (r["kept"] and failed)


def test_cascade_order_changes_nothing(spark):
    df = quality.with_counts(spark.createDataFrame([(1, "a b # # #"), (2, "plain words of text here"), (3, None)], "doc_id long, text string"))
    rules = quality.default_rules()
    verdict = lambda order: {r[0]: r[1] is None for r in df.select("doc_id", quality.cascade(order)).collect()}
    assert verdict(rules) == verdict(rules[::-1]) and len(quality.ordered(df, rules)) == len(rules)


# vectors


def test_op4(spark, sf):
    rows = {r["vec_id"]: r for r in answers(spark, sf, "op4_embedding_near_dedup")}
    check_vectors(rows, duckdb.sql(f"SELECT vec_id, label, embedding FROM read_parquet('{sf}/embeddings.parquet')").fetchall(), 1.0)


def check_vectors(rows, vectors, recall):
    links = []
    for i, (a, la, x) in enumerate(vectors):
        for b, lb, y in vectors[:i]:
            if la is not None and la == lb and len(x) == len(y):
                x_, y_ = np.asarray(x, float), np.asarray(y, float)
                if x_ @ y_ / np.sqrt((x_ @ x_) * (y_ @ y_)) >= 0.93:
                    links.append((a, b))
    count = Counter(n for link in links for n in link)
    found = sum(r["n_links"] for r in rows.values())
    assert all(rows[n]["n_links"] <= count[n] for n in rows) and found >= recall * 2 * len(links)
    if recall == 1:
        label = closure(list(rows), links)
        assert all((r["n_links"], r["component_id"], r["kept"]) == (count[n], label[n], label[n] == n) for n, r in rows.items())


def test_near_vectors(spark):
    """Pairs over the whole range above the threshold, many lists: recall against brute force."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(500, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.normal(size=base.shape)
    aside -= (aside * base).sum(1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = rng.uniform(0.9, 1, (500, 1))
    both = np.vstack([base, base, cosine * base + np.sqrt(1 - cosine**2) * aside]).astype(np.float32)
    vectors = [(i, i % 3 if i < 1000 else i % 500 % 3, v.tolist()) for i, v in enumerate(both)]
    got = embeddings.near_duplicates(spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>"), lists=24)
    check_vectors({r["vec_id"]: r for r in got.collect()}, vectors, 0.99)


@pytest.mark.parametrize("shape", ["low rank", "mixed lengths"])
def test_no_near_vector_is_missed(spark, shape):
    """Pairs right above the threshold: vectors of rank 6 in 64 dimensions, and one long vector among short ones."""
    rng = np.random.default_rng(11)
    rank, width = (6, 64) if shape == "low rank" else (8, 8)
    base = rng.normal(size=(700, rank))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.normal(size=base.shape)
    aside -= (aside * base).sum(1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = rng.uniform(0.931, 0.94, (700, 1))
    turn = np.linalg.qr(rng.normal(size=(width, rank)))[0].T
    both = np.vstack([base, cosine * base + np.sqrt(1 - cosine**2) * aside]) @ turn
    vectors = [(i, i % 700 % 3, v.tolist()) for i, v in enumerate(both.astype(np.float32))]
    if shape == "mixed lengths":
        vectors.append((len(vectors), 0, rng.normal(size=4096).astype(np.float32).tolist()))
    got = embeddings.near_duplicates(spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>"), lists=24)
    check_vectors({r["vec_id"]: r for r in got.collect()}, vectors, 1.0)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (3, None, [1.0, 0.0]), (4, 1, None), (5, 1, []), (6, 1, [0.0, 0.0]), (7, 1, [1.0, None]), (8, 1, [nan, 1.0]), (9, 1, [inf, 1.0]), (10, 1, [2.0, 0.1]), (11, 1, [1.0]), (12, 2, [1.0, 0.0]), (None, 1, [1.0, 0.0])]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>").withColumn("n", F.lit(1))
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect()}
        alone = {i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11, 12, None)}
        assert got == alone | {1: (2, 1, True), 2: (2, 1, False), 10: (2, 1, False)}
        assert embeddings.near_duplicates(df.limit(0)).collect() == []


# toxicity


def test_op5_on_held_out_labels(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4))
    chain = toxicity.train(docs, labels.where(fold > 0))
    held = labels.where((fold == 0) & F.col("toxic").isNotNull())
    rows = toxicity.score(docs, chain).join(held, "doc_id").select("is_toxic", "toxic").collect()
    hit = Counter((r["is_toxic"], r["toxic"]) for r in rows)
    assert hit[True, 1] >= 0.9 * (hit[True, 1] + hit[False, 1]) and hit[False, 0] >= 0.97 * (hit[True, 0] + hit[False, 0])


# secrets


def brute_spans(text):
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_op6(spark, sf, docs):
    rows = {r["doc_id"]: r for r in answers(spark, sf, "op6_secret_scan")}
    for i, text in docs:
        spans = brute_spans(text or "")
        said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        count = Counter(k for _, _, k, _ in spans)
        r = rows[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (count["assign"], count["access"], count["hex"], hashlib.sha256(said.encode()).hexdigest())
        assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))


def test_base_spans_on_hard_texts():
    for t in ("password=short token: 'longenough1' Passwd\"  =  x", "aKIAKIA1234567890AB AKIAAKIA12345678", "f" * 31 + " " + "g" + "0" * 40 + "A" + "b" * 32, "secret=token=abcdefgh1", "api_key:apikey=12345678", "paſsword=12345678 toKen=12345678"):
        assert secrets.base_spans(t) == brute_spans(t)


def test_names_and_literals_of_any_length(spark):
    rng = np.random.default_rng(5)
    long = "".join(rng.choice(list("abcXYZ0189+/"), 10000))
    name = ".".join(["part"] * 40)
    pem = "-----BEGIN RSA PRIVATE KEY-----" + r"\n".join([long[:64]] * 150) + "-----END RSA PRIVATE KEY-----"
    cases = [('private_key = "', long, '"'), ("db_pwd: '", long, "'"), ("jwt_auth = ", long, " "), ("credential => `", long, "`"), ('"private_key": "', pem, '"'), (f"{name}.db_pwd = '", long[:20], "'"), ('db_pwd = "', long[:5000] + r"\"" + long, '"')]
    rows = [(i, f"{a}{v}{b}") for i, (a, v, b) in enumerate(cases)]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (a, v, _) in enumerate(cases):
        assert f"literal:{len(a)}:{len(a) + len(v)}" in got[i].split(",")


def test_lexer_is_linear():
    import time

    for text in ('a="', "a='", "a=`", 'a="x"+', '"a', "a.", "a ", "a= ", 'x="\\"', "a=b+", "a:'\"`"):
        begun = time.process_time()
        secrets.pairs(text * 100000)
        assert time.process_time() - begun < 10, text


def test_constants_reach_sensitive_names():
    text = 'base = "kJ8#mQ2!zP9@"\nother = "kJ8mmm2zP9x"\ndb_password = base\ncolor: "kJ8#mQ2!zP9@"\nclient_secret => \'Zx9+\' + "Qw4rTy7!pL"'
    spans = {text[a:b] for a, _, _, b in secrets.assigned(text)}
    assert spans == {"kJ8#mQ2!zP9@", "Zx9+", "Qw4rTy7!pL"} and len(secrets.assigned(text)) == 3
    assert secrets.assigned('password = "changeme"\ntoken = "your_token"') == []


def spans_without_hint(text):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(secrets.base_spans(text) + secrets.assigned(text)))


def test_every_text_with_spans_is_scanned(spark, docs):
    """The query against the rules run on every text; values with any first sign, names with any last one."""
    values = [f"{c}9Xk2Lm+Qz8vT4wR1" for c in map(chr, range(33, 127)) if c not in "\"'`,;)}]"] + ["é9Xk2Lm+Qz8vT4wR1", "\x0b9Xk2Lm+Qz8vT4wR1"]
    texts = [f"{name} {sign}{gap}{v}" for v in values for name, sign, gap in (("db_pwd", "=", " "), ("jwt_auth", ":", "\t"), ("credential_dsn$", ":=", ""), ("private_key.", "=>", " "), ("'bearer-jwt-'", "=", ""))]
    rows = [*enumerate(texts), *((len(texts) + i, t or "") for i, (_, t) in enumerate(docs))]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: spans_without_hint(t) for i, t in rows} and sum(map(bool, got.values())) > 300
    assert got[texts.index("db_pwd = /9Xk2Lm+Qz8vT4wR1")] and got[texts.index("jwt_auth :\t+9Xk2Lm+Qz8vT4wR1")]


# packing


def test_op7(spark, sf, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*coder.encode(t or "", add_special_tokens=False).ids, 2] for i, t in docs}
    rows = answers(spark, sf, "op7_best_fit_packing")
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(own)):
            assert (piece, start) == (k, at) and crc == zlib.crc32(np.array(ids[i][at : at + length], "<u4").tobytes()) and (length == 1024 or k == 0)
            at += length
        assert at == len(ids[i]) and len(own) == -(-at // 1024)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= 1.02 * (-(-sum(map(len, ids.values())) // 1024)) + 1


def test_chunks_equal_the_whole_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for t in ("", " ", "a b", " a  b ", "a\n b\n\nc", "a \nb", "don't  stop'll", "x\t y", "é  b c d e", "😀 😀", "1 23 456", "a\r\n b", "　 a", "a  b"):
        assert np.frombuffer(own.text(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_plans_hold_all_pieces():
    rng = np.random.default_rng(1)
    for n in (1, 5, 300):
        histogram = Counter(rng.integers(1, 101, n).tolist())
        for groups in (0, 4, 16):
            runs = packing._grouped(histogram, 100, 0.25 if groups else 1.0, groups)
            held = Counter()
            for content, count in runs:
                assert sum(content) <= 100 and count > 0
                held.update({x: k * count for x, k in Counter(content).items()})
            assert held == histogram
    exact = packing.plan({60: 10, 40: 10}, 100)
    assert sum(c for _, c in exact) == 10


# MinHash


def shingles(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(docs):
    sets = {i: shingles(t) for i, t in docs}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    pairs = Counter((a, b) for m in by.values() for k, a in enumerate(m) for b in m[k + 1 :])
    links = [(a, b) for (a, b), n in pairs.items() if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n)]
    return sets, closure(list(sets), links)


def test_op8(spark, sf, docs):
    sets, label = near(docs)
    for r in answers(spark, sf, "op8_minhash_near_dedup"):
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), label[r["doc_id"]], label[r["doc_id"]] == r["doc_id"])


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(2)
    value = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sign = minhash.superminhash(np.concatenate([value[:200], value[100:]]), np.array([0, 200, 400, 400]), 400)
    assert abs((sign[0] == sign[1]).mean() - 1 / 3) < 0.06 and np.isinf(sign[2]).all()
    again = minhash.superminhash(value[:200][::-1].copy(), np.array([0, 200]), 400)
    assert (again[0] == sign[0]).all()


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        own = base.copy()
        for j in rng.choice(120, rng.integers(0, 6), replace=False):
            own[j] = f"x{i}_{j}"
        rows.append((i, " ".join(own)))
    _, label = near(rows)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == label


def test_bands_and_screen_follow_the_threshold():
    from math import comb

    assert (minhash.bands_for(85), minhash.screen_for(85, 100), minhash.bands_for(80, 4, 1e-6), minhash.bands_for(100)) == (20, 65, 27, 1)
    for percent in (60, 70, 80, 85, 95):
        p, m = percent / 100, 5 * minhash.bands_for(percent)
        assert (1 - p**5) ** (m // 5) <= minhash.MISS < (1 - p**5) ** (m // 5 - 1)
        assert sum(comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(minhash.screen_for(percent, m))) <= minhash.MISS / 40


def test_near_copies_from_080(spark):
    """Copies at 0.80 to 0.849 in groups of three."""
    rows = []
    for g in range(60):
        base = [f"w{g}_{i}" for i in range(49 + g)]
        n = len(base) - 4
        # d changed words at the end take d of the n shingles from each side
        most = next(d for d in range(n, 0, -1) if 100 * (n - d) >= 80 * (n + d))
        rows += [(3 * g, " ".join(base)), *((3 * g + k, " ".join(base[:-most] + [f"x{g}_{k}_{i}" for i in range(most)])) for k in (1, 2))]
    assert near(rows)[1] == {i: i for i, _ in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, percent=80, rows=4, miss=1e-6).collect()}
    assert got == {i: i - i % 3 for i, _ in rows}


# SentencePiece


def test_op9(spark, sf, docs):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    encoded = queries.op9_sentencepiece_wfst(spark, sf)
    rows = {r["doc_id"]: r for r in encoded.collect()}
    for i, text in docs:
        assert rows[i]["ids"] == model.encode(text or "") and rows[i]["n_ids"] == len(rows[i]["ids"])
    back = {r["doc_id"]: r["text"] for r in sentencepiece_wfst.decode(encoded).collect()}
    assert all(back[i] == (text or "") for i, text in docs if rows[i]["decodes_back"])
    assert sum(r["decodes_back"] for r in rows.values()) >= 0.9 * len(rows)


def test_transducer_on_hard_texts():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_wfst.machine(path)
    for t in ("", " ", "  a  b ", "▁x ▁", "日本語 😀\n\t", "aaaaaaaaaaaa" * 20, "\x00\x01", "Ünïcödé’s “q”", "<s></s><unk>", "<0x41>", "éé"):
        assert own.encode(t) == model.encode(t) and own.decode(own.encode(t)) == model.decode(model.encode(t))


# substrings


def without(docs, size=13):
    first = {}
    own = {i: words(t) for i, t in docs}
    for i, w in sorted(own.items()):
        for j in range(len(w) - size + 1):
            first.setdefault(tuple(w[j : j + size]), i)
    out = {}
    for i, w in own.items():
        gone = {j + o for j in range(len(w) - size + 1) if first[tuple(w[j : j + size])] < i for o in range(size)}
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def test_op10(spark, sf, docs):
    expected = without(docs)
    for r in answers(spark, sf, "op10_substring_dedup"):
        n, gone, kept = expected[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_automata_agree(spark, docs):
    some = docs[:60]
    expected = without(some)
    df = spark.createDataFrame(some, "doc_id long, text string")
    for r in substring.remove_by_automata(df, shard_words=3000).collect():
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (*expected[r["doc_id"]][:2], hashlib.sha256(expected[r["doc_id"]][2].encode()).hexdigest())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.sql(queries.oracle_sql()[name])
    rows = answers(spark, sf, name)
    expected = [{c: v for c, v in zip(want.columns, r, strict=True)} for r in want.fetchall()]
    assert sorted((r.asDict() for r in rows), key=lambda r: next(iter(r.values()))) == sorted(({c: r[c] for c in rows[0].asDict()} for r in expected), key=lambda r: next(iter(r.values())))


# the pipeline


def test_pipeline(spark, sf, docs):
    import corpus_pipeline

    from tests.llm.brute import pipeline

    table = duckdb.sql(f"SELECT * FROM read_parquet('{sf}/documents.parquet')")
    names = table.columns
    rows = [dict(zip(names, r, strict=True)) for r in table.fetchall()]
    expected = pipeline(rows)
    got = corpus_pipeline.run(spark, sf).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["piece"], r["length"], r["ids_crc32"]))
    assert {i: sorted(p) for i, p in by.items()} == expected


def test_stages_keep_columns_and_take_odd_tables(spark, odd, sf):
    import corpus_pipeline

    assert corpus_pipeline.STAGES[0][1](spark, odd, sf).columns == odd.columns
    now = odd
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        now = stage(spark, now, sf)
        assert now.columns == odd.columns and dict(now.dtypes)["n_chars"] == "bigint"
        now = spark.createDataFrame(now.collect(), now.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, now, sf).count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), sf).collect() == []
