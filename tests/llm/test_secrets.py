import hashlib
import random
import re
import string

from notegraph.llm import queries, secrets

PATTERNS = [
    ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def brute(text):
    found = [(m.start(), i, m.end(), kind) for i, (kind, p, good) in enumerate(PATTERNS) for m in p.finditer(text or "") if good(m)]
    return sorted(found)


def random_token(seed, n, alphabet):
    r = random.Random(seed)
    return "".join(r.choice(alphabet) for _ in range(n))


B64 = string.ascii_letters + string.digits + "+/"
HEXA = "0123456789abcdef"


def texts(prose):
    out = [None, "", "password=abc", "PassWord: 'abcdef'", "é password = x.y-z_123 é", "pa\u017fsword=abcdef", "to\u212aen=abcdef", "token=token=abcdefg", "api_key:abcdef apikey=123456", "secret  =  \"a+/=b.c\""]
    out += ["AKIA" + "A" * 15, "xAKIA" + "B7" * 8 + "é", "AKIAAKIA" + "1" * 20, "é" * 30 + random_token(1, 40, HEXA) + "g", "f" * 23 + " " + "f" * 24, "A" + random_token(2, 30, HEXA) + "Z"]
    out += [prose(50_000, 1) + " password=hunter22 " + prose(10)]
    return out


def test_base_spans_against_brute_force(spark, prose):
    rows = list(enumerate(texts(prose)))
    got = {r["doc_id"]: r for r in secrets.find_secrets(spark.createDataFrame(rows + rows[-1:], "doc_id long, text string")).collect()}
    for i, text in rows:
        assert [tuple(s) for s in got[i]["base"]] == brute(text), text and text[:60]
        assert {tuple(s) for s in got[i]["spans"]} >= set(brute(text))


def test_the_battery_tells_random_from_prose(spark, prose):
    rows = [(i, prose(80, i) + " word" + "".join(prose(6, 900 + i).split()) + " " + "ab" * 14 + " 1234567890123456789012345") for i in range(300)]
    planted = {}
    for i in range(0, 300, 10):
        token = random_token(i, 44, B64)
        rows[i] = (i, rows[i][1] + " " + token)
        planted[i] = (len(rows[i][1]) - 44, len(rows[i][1]))
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "random"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = sum(planted[i] in got[i] for i in planted)
    wrong = sum(len([s for s in got[i] if s != planted.get(i)]) for i in got)
    assert hit >= 27 and wrong == 0, (hit, wrong)


def test_parts_of_runs():
    def texts_of(run):
        raw = run.encode()
        return [raw[s:e].decode() for s, _, e in secrets.parts(raw, 0, len(raw))]

    a, b = "a" * 20, "b" * 21
    assert texts_of(f"{a}={b}==") == [a, f"{b}=="] and texts_of(f"=={a}=x={b}") == [a, b]
    assert texts_of(f"{a}/{b}+x") == [f"{a}/{b}+x"] and texts_of(f"{a}-{b}_x=") == [f"{a}-{b}_x="]
    assert texts_of(f"/p/x_{a}=") == [f"x_{a}=", f"{a}="] and texts_of(f"{a}/-{b}") == [a, a + "/", "-" + b, b]
    assert texts_of("a" * 19 + "=" * 5) == []


def test_tokens_behind_names_and_paths(spark, prose):
    forms = ["sessionid={}", "GITHUB_PAT=ghp_{}", "http://x.org/?a=b&sig={}", "AccountKey={}==", "http://x.org/download/auth_{}", "see/a-b/{}"]
    rows, planted = [], {}
    for i in range(300):
        text = prose(80, i) + " colour=" + "".join(prose(6, 900 + i).split()) + " some/long-path/of_words/in/it "
        if i % 5 == 0:
            token = random_token(i, 44, string.ascii_letters + string.digits)
            text += forms[i // 5 % 6].format(token)
            planted[i] = token
        rows.append((i, text + " " + prose(20, i)))
    got = {r["doc_id"]: [rows[r["doc_id"]][1][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "random"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for form in range(6):
        assert sum(any(planted[i] in x for x in got[i]) for i in planted if i // 5 % 6 == form) >= 9, (form, got)
    assert all(planted.get(i, " ") in x for i in got for x in got[i])


def test_uniform_tests():
    import numpy as np

    r = np.random.default_rng(3)
    passed = sum(min(secrets.uniform_tests(r.integers(0, 64, 40), 64)) > 0.001 for _ in range(500))
    assert passed > 485
    for bad in (np.zeros(40, int), np.arange(40) % 2, np.arange(40), np.repeat([0, 63], 20)):
        assert min(secrets.uniform_tests(bad, 64)) < 0.001


def test_strings_that_are_neither_text_nor_chance(spark, prose):
    """Long prose-like names, patterns and rules have no small p-value; random strings of many lengths do."""
    plain = ["getElementByIdAndReturnTheResultOfAll", "AbstractSingletonProxyFactoryBean", "THISISALLUPPERCASETEXTANDNOSECRET", "usr/local/share/python/site/packages", "this_is_a_long_name_of_some_thing_2", "2024-01-01-12-30-59-backup-file-01", "A" * 40, "-" * 30, "_" * 40, "xo_" * 12, string.ascii_lowercase, string.ascii_uppercase + string.digits, "com/en/articles/2024/12/31/the-title-of-it"]
    for x in plain:
        assert all(p > 0.01 for *_, p in secrets.scan_text(f"{prose(300)} {x} {prose(300, 1)}".encode())[1]), x
    for seed in range(40):
        token = random_token(seed, 24 + seed, string.ascii_letters + string.digits)
        for form in ("{}", "org/files/list/of/things/{}", "files/{}/get"):
            text = f"{prose(300, seed)} {form.format(token)} {prose(300, 1)}"
            found = secrets.scan_text(text.encode())[1]
            assert any(p < 1e-4 and token in text[s:e] for s, e, _, p in found), (form, token, found)


def test_the_battery_counts_in_the_p_value():
    r = random.Random(4)
    counts = secrets._PRIOR * 100
    letters = string.ascii_letters + string.digits
    for _ in range(20):
        token = "".join(r.choice(letters) for _ in range(40))
        ordered = "".join(sorted(token))  # the same symbols, so the same likelihood ratio; not their order
        assert secrets.random_p(token.encode(), counts) < 1e-3 and secrets.random_p(ordered.encode(), counts) > 0.5


def test_clashing_columns_of_a_full_table(spark, prose):
    rows = [(1, f"{prose(50)} password=hunter22", 7, "x", 1), (1, f"{prose(50)} password=hunter22", 7, "x", 1), (None, None, 7, "x", 1)]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, base int, spans string, tried int")).collect()
    assert sorted(((r["doc_id"], len(r["base"])) for r in got), key=repr) == [(1, 1), (1, 1), (None, 0)]


def test_empty_table(spark):
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id long, text string, base int, spans string")).collect() == []


def test_query(spark, sf_dir):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op5_secret_scan(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        base = brute(rows[r["doc_id"]])
        line = ",".join(f"{k}:{s}:{e}" for s, _, e, k in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(b[1] == i for b in base) for i in range(3)]
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))
