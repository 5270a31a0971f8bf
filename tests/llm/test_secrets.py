import hashlib
import random
import re

from pyspark.sql import functions as F

from rallyspark.llm import queries, secrets

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return sorted(found)


def test_base_spans(spark, docs):
    rng = random.Random(2)
    parts = ["password=", "Api_Key: '", "TOKEN =\"", "secret", "abcdefghijkl", "AKIA", "ABCDEFGHIJ1234", "deadbeef", "0123456789abcdef", " ", "é", "😀", "\n", "x", "=", "passwd:'short'", "akıa", "ſecret=aaaaaaaaaaaaaaaa", "toKen=aaaaaaaaaaaaaaaa"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 40)))) for i in range(400)]
    many = spark.createDataFrame(rows, "doc_id long, text string").union(docs.where("doc_id is not null").dropDuplicates(["doc_id"]).selectExpr("doc_id + 1000", "text"))
    texts = {r.doc_id: r.text for r in many.collect()}
    for r in secrets.scan(many).collect():
        want = base(texts[r.doc_id])
        assert [(s.start, s["rank"], s.end, s.kind) for s in r.base] == want, texts[r.doc_id]
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(7)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    good = ["".join(rng.choices(letters, k=40)) for _ in range(20)]
    plain = ["internationalization_and_localization", "CamelCaseNamesOfClasses2024AndMethods", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaA1"]
    rows = [(i, f"see {t} there") for i, t in enumerate(good + plain * 7)]
    found = {r.doc_id: [s.kind for s in r.spans] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("random" in found[i] for i in range(20)) >= 18
    assert not any("random" in found[i] for i in range(20, len(rows)))


def recall(spark, letters: str, plain: list[str]) -> list[float]:
    """Share of random tokens of 20, 24 and 32 characters of an alphabet that are found beside ordinary ones, of which none may be."""
    rng = random.Random(11)
    tokens = [(n, "".join(rng.choices(letters, k=n))) for n in (20, 24, 32) for _ in range(100)]
    rows = [(i, n, f"see {t} there") for i, (n, t) in enumerate(tokens + [(0, t) for t in plain])]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, n long, text string"))
    shares = {r.n: r.share for r in found.groupBy("n").agg(F.avg(F.exists("spans", lambda s: s["kind"] == "random").cast("int")).alias("share")).collect()}
    assert not plain or shares[0] == 0
    return [shares[n] for n in (20, 24, 32)]


def test_recall_of_upper_case_hex_and_base32(spark):
    at = recall(spark, "0123456789ABCDEF", ["DEADBEEFDEADBEEF0000", "AAAAAAAABBBBBBBBCCCC1111", "00000000000000000000000000000ABC"])
    assert at[0] >= 0.8 and at[1] >= 0.85 and at[2] >= 0.9, at
    at = recall(spark, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ["INTERNATIONALIZATION22", "CONFIGURATIONSETTINGS2", "FRAMEWORKINSTALLATIONDIRECTORIES7"])
    assert at[0] >= 0.6 and at[1] >= 0.7 and at[2] >= 0.85, at


def test_recall_of_tokens_of_no_common_encoding(spark):
    plain = ["internationalization", "formatannotationrelativeto", "getincrementalencoder", "PYTHONFRAMEWORKINSTALLDIR", "ASSIGNMENTEXPRESSIONS1890", "ContentDispositionHeader", "test_split_rubber_player_names", "docs/guides/getting-started/index"]
    for letters in ("abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"):
        at = recall(spark, letters, plain)
        assert at[0] >= 0.6 and at[1] >= 0.7 and at[2] >= 0.85, (letters, at)


def test_query_digests(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op8_secret_scans(spark, sf_dir).collect():
        want = base(docs[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[1] == k for w in want) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest()


def test_redaction(spark, docs, wide, empty):
    out = {r.doc_id: r for r in secrets.redacted(wide).collect()}
    assert out[6].text == "[SECRET] and [SECRET] plus [SECRET]" and out[6].n_chars == len(out[6].text)
    assert out[3].text is None and out[4].text == "" and out[1].text.startswith("The quick")
    assert "token=" not in out[9].text and out[9].n_chars == len(out[9].text)
    again = secrets.redacted(wide)
    assert again.columns == wide.columns and {r.base for r in again.select("base").collect()} == {"own base"}
    assert secrets.redacted(empty).count() == 0
    many = spark.createDataFrame([(1, "deadbeefdeadbeef " * 2000)], "doc_id long, text string")
    spans = secrets.scan(many).select(F.size("spans").alias("n"), F.element_at("spans", -1)["end"].alias("e")).first()
    assert (spans.n, spans.e) == (2000, 2000 * 17 - 1)
