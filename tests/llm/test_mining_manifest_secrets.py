"""Collocations, manifests and secret scans against brute force, with nulls, empty and long texts, ties, repeated rows,
empty tables and clashing names."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterlake.llm import collocations, merkle, registry, secrets, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# 11: collocations
def mined(rows, least, cover=80, first=2000):
    """Plain counting of every phrase."""
    counts, totals = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            totals[lang] += len(w)
            counts.update((lang, w[i : i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
    frequent = {k: n for k, n in counts.items() if n >= least and len(k[1]) > 1}
    covered = collections.Counter()
    for (lang, w), n in frequent.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                covered[lang, w[i : i + m]] = max(covered[lang, w[i : i + m]], n)
    out = []
    for (lang, w), a in frequent.items():
        score, k = min((2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w)))
        if 100 * covered[lang, w] < cover * a:
            out.append((lang, -score, -a, " ".join(w), counts[lang, w[:k]], counts[lang, w[k:]]))
    out.sort(key=lambda r: (r[0], r[1], r[2], r[3].encode()))
    found, place = [], collections.Counter()
    for lang, score, a, phrase, left, right in out:
        place[lang] += 1
        if place[lang] <= first:
            found.append((lang, place[lang], phrase, -a, left, right, totals[lang], -score))
    return found


def odd_texts():
    rng = np.random.default_rng(5)
    vocabulary = ["of", "the", "new", "York", "city", "é", "été.", "a,b", "x\ty", "z\n", "a|b", "END!", " "]
    rate = np.arange(1, len(vocabulary) + 1) ** -0.7
    make = lambda n: " ".join(rng.choice(vocabulary, n, p=rate / rate.sum()))
    base = make(120)
    texts = [None, "", " \n\t.,", "one", "two words", base, base, base.upper(), make(3000), make(900), "the same " * 2500, "a" * 5000 + " of the", *(make(int(n)) for n in rng.integers(1, 80, 60))]
    langs = ["en", "fr", None, "und"]
    return [(t, langs[i % 4]) for i, t in enumerate(texts)] + [(base, "en")] * 3


@pytest.mark.parametrize("least,chunk", [(2, 1 << 20), (30, 1 << 20), (5, 2_000)])
def test_collocations_against_plain_counting(spark, monkeypatch, least, chunk):
    rows = odd_texts()
    monkeypatch.setattr(words.chunks, "__defaults__", (chunk,))
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    docs = docs.withColumns({"rank": F.lit("clash"), "phrase": F.lit(1), "n": F.lit(None), "chunk": F.lit(2)})
    found = collocations.collocations(docs, least=least, first=40)
    got = sorted((tuple(r) for r in found.collect()), key=lambda r: (r[0], r[1]))
    assert got == mined(rows, least, first=40) and len(got) > 40
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_chunks_hold_each_phrase_once(monkeypatch):
    """Whatever cuts a text into chunks, the phrases that they own are those of the text."""
    rows = [t for t, _ in odd_texts()]
    want = collections.Counter()
    for t in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update(" ".join(w[i : i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
    for spacing, most in ((32, 1024), (1, 1024), (2, 7), (10**9, 5), (10**9, 10**9)):
        monkeypatch.setattr(collocations, "SPACING", np.uint64(spacing))
        monkeypatch.setattr(collocations, "MOST_WORDS", most)
        batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(rows)), pa.array(rows)], names=["lang", "text"])
        got = collections.Counter()
        for out in collocations._chunks([batch]):
            for (part,) in [list(words.split(out.column(2), space=collocations.BETWEEN))]:
                phrases = collocations.Phrases(part, out.column(1).to_numpy(zero_copy_only=False), np.zeros(part.rows, np.uint64))
                for order in range(1, 5):
                    got.update(collocations._spelled(part, phrases.wanted(order, None), order).to_pylist())
        assert got == want, spacing


def test_equal_passages_have_equal_chunks():
    rng = np.random.default_rng(2)
    passage = " ".join(f"w{n}" for n in rng.integers(0, 500, 2000))
    texts = [passage, "some other words before " + passage, passage + " and more behind", "one, two " + passage]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(texts)], names=["lang", "text"])
    sets = collections.Counter(c for out in collocations._chunks([batch]) for c in out.column(2).to_pylist())
    assert sum(n for n in sets.values() if n == 4) > 0.8 * sum(sets.values())


def test_collocation_scores_beyond_64_bits(spark):
    """Products that pass 64 bits are exact: the expression over large counts."""
    row = spark.createDataFrame([(3 * 10**17, 4 * 10**17, 5 * 10**17 + 1)], "a bigint, l bigint, r bigint")
    got = row.select(F.expr("2000000 * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + r)").alias("s")).first()[0]
    assert got == 2_000_000 * 3 * 10**17 // (9 * 10**17 + 1)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en")], empty.schema), least=1).collect() == []


# 12: manifests
def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def manifest_of(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) by building whole trees in memory."""

    def climb(nodes):
        """(last node, siblings with places of each first node)"""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for path, p in zip(paths, at, strict=True):
                run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
                path.append((p % 16, run[: p % 16], run[p % 16 + 1 :]))
            nodes, at = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], [p // 16 for p in at]
        return nodes[0] if nodes else None, paths

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = own, *climb([leaf_of(r) for r in own])
    root, tops = climb([trees[s][1] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            node = leaf_of(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                node = leaf_of((*r[:4], r[4].translate(LOW) if r[4] else r[4]))
            for _, left, right in path + top:
                node = H(*left, node, *right)
            proof = H(*(d for _, left, right in path + top for d in left + right))
            out.append((r[0], leaf_of(r), subroot, root, proof, node, node == root))
    return out


def documents(sizes):
    """Documents of sources of some sizes, with nulls, repeated ids and repeated rows."""
    rng, rows = np.random.default_rng(8), []
    for s, size in sizes.items():
        for k in range(size):
            text = [None, "", "Plain", "Ünï Code\nX", "lower only", "A" * 3000][rng.integers(6)]
            rows.append((int(rng.integers(0, 3 * size)), s, ["en", None][k % 2], None if k % 3 else len(text or ""), text))
    return rows + rows[:5] + [(None, next(iter(sizes)), None, None, None)] * 2


FIELDS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 1},
        {"a": 16, None: 17},
        {None: 1, "": 1, "b": 300, "é": 40, "z": 16},
        {f"s{k}": 1 + k % 3 for k in range(40)} | {"hot": 600},
    ],
)
def test_manifest_against_whole_trees(spark, sizes):
    rows = documents(sizes)
    rows = rows if sizes != {"a": 1} else rows[:1]
    docs = spark.createDataFrame(rows, FIELDS).repartition(5)
    docs = docs.withColumns({"leaf": F.lit("clash"), "root": F.lit(1), "tree": F.lit(2), "number": F.lit(3), "digest": F.lit(4)})
    found = merkle.tamper_check(docs)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r) for r in found.collect()), key=key)
    want = sorted(manifest_of(rows), key=key)
    assert got == want
    if len(rows) > 20:
        assert {r[-1] for r in got} == {True, False}


def test_manifest_proofs_and_carried_columns(spark):
    rows = [(k, "ab"[k % 2], "en", k, f"Text {k}") for k in range(100)]
    docs = spark.createDataFrame(rows, FIELDS).withColumn("at", F.lit("kept"))
    made = merkle.manifest(docs, carry=("at", "lang")).collect()
    for r in made:
        node = r["leaf"]
        for step in r["proof"]:
            node = H(*step["siblings"][: step["place"]], node, *step["siblings"][step["place"] :])
        assert node == r["root"] and (r["at"], r["lang"]) == ("kept", "en")
        assert len(r["proof"]) == 3
    assert len({r["root"] for r in made}) == 1 and len({r["subroot"] for r in made}) == 2
    assert merkle.manifest(docs.limit(0)).collect() == []


# 13: secrets
def planted():
    rng = np.random.default_rng(4)
    hexes = "0123456789abcdef"
    bits = ["token = ", "API_KEY:", "passwd'=\"", "Secret : ", "apikey=", "password", "=", '"', " ", "\n", "AKIA", "AKIA" + "Q7" * 8, "abcdefgh1", "short", "é", "ſecret=abcdefghij", "toKen=abcdefghij"]
    bits += ["".join(rng.choice(list(hexes), int(n))) for n in (31, 32, 33, 64)]
    return ["".join(rng.choice(bits, int(n))) for n in rng.integers(1, 60, 400)] + [None, "", "x " * 40_000 + "token=abcdefgh12"]


def plain_spans(text):
    """Every kind by stepping through the text."""
    out, low = [], text.translate(LOW)
    at = 0
    while at < len(text):
        key = next((k for k in ("password", "passwd", "secret", "token", "apikey", "api_key") if low.startswith(k, at)), None)
        end = at + len(key) if key else at
        if key:
            end += text[end : end + 1] in ('"', "'") and bool(text[end : end + 1])
            while text[end : end + 1] == " ":
                end += 1
            if text[end : end + 1] in (":", "="):
                end += 1
                while text[end : end + 1] == " ":
                    end += 1
                end += text[end : end + 1] in ('"', "'") and bool(text[end : end + 1])
                value = re.match(r"[A-Za-z0-9+/_.=-]*", text[end:])[0]
                if value:
                    if len(value) >= 8:
                        out.append((at, "assign", end + len(value)))
                    at = end + len(value)
                    continue
        at += 1
    for kind, first, chars, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), ("hex", "", "0123456789abcdef", 32)):
        at = 0
        while at < len(text):
            end = at + len(first)
            if text.startswith(first, at) and text[end : end + 1] and text[end] in chars:
                while end < len(text) and text[end] in chars:
                    end += 1
                if end - at >= least:
                    out.append((at, kind, end))
                at = end
            else:
                at += 1
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[1])))


def test_plain_secrets_against_stepping():
    total = 0
    for text in planted():
        want = plain_spans(text or "")
        got = [(f["start"], f["kind"], f["end"]) for f in secrets.scan(text or "") if f["kind"] != "named"]
        assert got == want, text
        total += len(want)
    assert total > 500


FOUND = {
    'KEY = "s3cr3t-Pa55"\nx = KEY\ndb_password = x\n': ["s3cr3t-Pa55"],
    'A = "part1-"\nB = "Xy7Zq!"\nconfig["db"]["passphrase"] = A + B;': ["part1-", "Xy7Zq!"],
    'password: str = "hunter2hunter"': ["hunter2hunter"],
    '{"client_secret": "aB3$kk9_zz", "name": "bob marley"}': ["aB3$kk9_zz"],
    "private String dbPassword = 'abcd-1234!EF';": ["abcd-1234!EF"],
    "ENV DB_PASSWORD p4ssw0rdXY\n": ["p4ssw0rdXY"],
    '#define SECRET_KEY "qwe123RTY"': ["qwe123RTY"],
    "<password>Zz9!kkqpw</password>": ["Zz9!kkqpw"],
    'props.put("access_token", "aa11BB22cc33");': ["aa11BB22cc33"],
    "K=abc123XYZ9\nDB_PWD=$K\n": ["abc123XYZ9"],
    'K=abc123XYZ9\nexport DB_PWD="${K}"\n': ["abc123XYZ9"],
    "db:\n  user: bob\n  pwd: aa11-BB22\n": ["aa11-BB22"],
    'passphrase = """two\nw0rds!"""': ["two\nw0rds!"],
}
CLEAN = ["password = getpass()", 'password_field = "pw_input_12"', "The secret: of the house is open", 'PASSWORD="${OTHER}"', "passphrase = <your passphrase>", "pwd: changeme", 'name = "abc123XYZ9"', "if password == 'abc123XYZ9': x", "public_key = 'abc123XYZ9'", "K = 'abc123XYZ9'\nK = load()\npwd = K", "Time: 12:30, le: de la"]


def test_lexer_finds_literals_of_sensitive_names():
    for text, want in FOUND.items():
        spans = [f for f in secrets.scan(text) if f["kind"] == "named"]
        assert [text[f["start"] : f["end"]] for f in spans] == want, text
    for text in CLEAN:
        assert [f for f in secrets.scan(text) if f["kind"] == "named"] == [], text


def test_cost_of_the_lexer_is_linear():
    """Texts that make careless patterns walk the same stretch again and again."""
    import time

    for unit in ("a.b", "a-b", "'", 'x="""', "a b ", "password ", "AKIA", "a[b]", "<a>", '\\"', "`a=`", "a: ", "x = A + ", "k=v "):
        took = []
        for n in (20_000, 80_000):
            began = time.perf_counter()
            secrets.scan(unit * n)
            took.append(time.perf_counter() - began)
        assert took[1] < 10 * took[0] + 0.5, unit
    assert secrets.scan('A="aB3$xx"\n' + "p=A+A\nA=p\n" * 500 + "pwd=p\n")[0]["kind"] == "named"


def test_secret_digests(spark, docs_schema):
    texts = planted() + list(FOUND) + CLEAN
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)] + [(0, texts[0], "en", "s", 0), (None, "token=abcdefgh", None, None, None)]
    docs = spark.createDataFrame(rows, docs_schema).repartition(3).withColumns({"found": F.lit(1), "spans": F.lit(2)})
    found = secrets.secret_digests(docs)
    assert found.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    want = []
    for d, t, *_ in rows:
        spans = [(f["kind"], f["start"], f["end"]) for f in secrets.scan(t or "")]
        text = lambda some: ",".join(f"{k}:{a}:{b}" for k, a, b in some)
        base = [s for s in spans if s[0] != "named"]
        want.append((str(d), *(sum(s[0] == k for s in spans) for k in secrets.KINDS[:3]), H(text(base)), text(spans)))
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == sorted(want)
    assert secrets.secret_digests(docs.limit(0)).count() == 0


def test_queries_are_registered():
    assert {"op11_collocations", "op12_merkle_manifest", "op13_secrets"} <= set(registry.queries())
    assert {"op11_collocations", "op12_merkle_manifest"} <= set(registry.oracle_sql())
