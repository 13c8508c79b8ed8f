"""Exact dedup, personal data, license scans, URL rules and mixing against brute force, with odd rows."""

import hashlib
import itertools
import random
import re
import string
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafgraph.llm import exact_dedup, license_scan, mixing, pii, queries, url_filter

DOCS = "doc_id long, text string, lang string, source string, kept boolean, copy int, component_id string, score double"
LONG = "word " * 60_000


def docs(spark, *texts, source="a"):
    return spark.createDataFrame([(i, t, None, source, None, None, "x", None) for i, t in texts], DOCS)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "ab"), (6, "a  b"), (6, "a  b"), (None, "ab"), (7, LONG), (8, "é\u00a0b"), (None, None)]


def test_exact_dedup(spark):
    got = exact_dedup.ingest(docs(spark, *ODD), exact_dedup.DigestIndex(spark)).collect()
    assert len(got) == len(ODD)
    groups = {}
    for i, t in ODD:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", t or ""), []).append((len(t or ""), -i if i else float("-inf"), i))
    want = Counter()
    for key, rows in groups.items():
        keep = max(rows, key=lambda r: r[:2])[2]
        for _, _, i in rows:
            want[i, keep, len(rows), i == keep, hashlib.sha256(key.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_exact_dedup_of_an_empty_table_and_of_a_hot_text(spark):
    assert exact_dedup.ingest(docs(spark, *ODD).limit(0), exact_dedup.DigestIndex(spark)).count() == 0
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.ingest(many, exact_dedup.DigestIndex(spark))
    assert got.where("kept").count() == 2001 and got.where("group_size = 1000 and keep_id = 0").count() == 1000


def test_later_batches_meet_the_index(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    assert exact_dedup.ingest(docs(spark, (5, "one"), (6, "two")), index).where("kept").count() == 2
    again = exact_dedup.DigestIndex(spark, path=index.path, buckets=3)
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.ingest(docs(spark, (1, "o n e"), (2, "three")), again).collect()}
    assert got == {1: (5, False), 2: (2, True)}
    assert again.rows().count() == 3
    plan = again.rows().join(index.rows(), "text_sha256")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan or "BroadcastExchange" in plan


def test_unique_documents_keep_one_row_and_all_columns(spark):
    rows = docs(spark, *ODD)
    got = exact_dedup.unique_documents(rows, exact_dedup.DigestIndex(spark))
    assert got.columns == rows.columns
    assert sorted(((r.doc_id or 0), len(r.text or "")) for r in got.collect()) == [(3, 3), (6, 4), (7, len(LONG)), (8, 3)]


def test_unique_documents_are_those_that_ingest_keeps_without_broadcasts(spark):
    texts = ["a", "a ", None, "", "b c", "bc", "d"]
    rows = docs(spark, *((i % 40 if i % 9 else None, texts[i * i % 7]) for i in range(200)))
    index = exact_dedup.DigestIndex(spark)
    exact_dedup.ingest(docs(spark, (99, "d")), index)
    got = exact_dedup.unique_documents(rows, index)
    kept = exact_dedup.ingest(rows, exact_dedup.DigestIndex(spark)).where("kept").select("doc_id", "text_sha256").distinct().collect()
    digest = got.select("doc_id", exact_dedup.text_digest(got["text"]).alias("sha")).collect()
    old = exact_dedup.ingest(docs(spark, (99, "d")), exact_dedup.DigestIndex(spark)).first().text_sha256
    assert sorted(map(str, digest)) == sorted(str(r).replace("text_sha256", "sha") for r in kept if r.text_sha256 != old)
    plans, write = [], exact_dedup.written
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(exact_dedup, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name))
        exact_dedup.unique_documents(rows, exact_dedup.DigestIndex(spark))
    assert len(plans) == 3 and not any("broadcast" in p for p in plans)


def test_unique_documents_keep_rows_of_repeated_null_and_unequal_texts(spark):
    rows = docs(spark, (1, None), (1, None), (2, "x"), (2, "x "), (2, "x"), (3, "y"), (3, "y"), (4, ""))
    got = exact_dedup.unique_documents(rows, exact_dedup.DigestIndex(spark)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == [(1, None), (2, "x "), (3, "y")]
    assert {r.source for r in got} == {"a"}


def test_a_batch_ingested_again_gets_the_same_answers(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    exact_dedup.ingest(docs(spark, (9, "old")), index, "first")
    batch = docs(spark, (1, "a"), (2, "a "), (3, "old"), (4, None))
    once = exact_dedup.ingest(batch, index, "second").collect()
    again = exact_dedup.ingest(batch, index, "second").collect()
    assert Counter(once) == Counter(again) and {r.doc_id for r in once if r.kept} == {2, 4}
    assert index.rows().count() == 3
    assert [r.kept for r in exact_dedup.ingest(batch, index, "third").collect()] == [False] * 4
    small = index.compacted()
    assert Counter(small.rows().collect()) == Counter(index.rows().collect())
    index.close()
    assert [r.kept for r in exact_dedup.ingest(batch, small).collect()] == [False] * 4


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(number))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            n = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 13 <= len(n) <= 19 and luhn(n), "phone": 9 <= len(n) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data(spark):
    texts = [
        "x a.b@c.de_y@z.org, é@x.y a@b a@b. a@b.c.",
        "1.2.3.4.5 256.1.1.1 0001.02.3.255 1.2.3 9.9.9.9",
        "4785380592391139 4785 3805-9239 1139 4785380592391138 1 2",
        "+1 (743) 555-3824 +1 2 +12345678901234567 +1-2",
        "日本 +49 30 1234567 日本 a@b.cd 🙂 10.0.0.1",
        "9" * 20_000,
        "a" * 100_000 + "@",
        LONG + " me@example.com",
        None,
        "",
    ]
    got = {r.doc_id: r for r in pii.personal_data(docs(spark, *enumerate(texts))).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (i, want, got[i].spans)
        assert got[i].spans.startswith(want)
        assert [got[i][f"n_{k}"] for k in BASE] == [want.count(k + ":") for k in BASE]
    assert pii.personal_data(docs(spark, (1, "x")).limit(0)).count() == 0


def test_secrets_are_found_among_other_codes(spark):
    secrets = [(i, f"some text token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" and password={hashlib.md5(str(i).encode()).hexdigest()[:18]} end") for i in range(40)]
    others = [(100 + i, f"order {10**15 + 7919 * i} was shipped, see part-{i:012d} of it") for i in range(40)]
    got = {r.doc_id: r for r in pii.personal_data(docs(spark, *secrets, *others)).collect()}
    assert all(got[i].n_secret == 2 for i, _ in secrets)
    assert all(got[i].n_secret == 0 for i, _ in others)
    t, (start, end) = secrets[0][1], map(int, got[0].spans.split(",")[0].split(":")[1:])
    assert t[start:end] == hashlib.sha1(b"0").hexdigest()


def test_very_many_matches_are_located_in_time(spark):
    n = 20_000
    text = " ".join(f"{i % 300}.1.2.{i % 256}" for i in range(n)) + " " + ",".join(str(10**15 + i) for i in range(n))
    table = docs(spark, (1, text))
    began = time.time()
    got = pii.personal_data(table).first()
    assert time.time() - began < 60  # a fold that copies what it has gathered took minutes
    want = base_spans(text)
    assert got.spans.startswith(want) and got.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    sizes = spark.createDataFrame([(list(range(k)),) for k in (0, 1, 2, 3, 4, 5, 9, 10, 17, 100)], "a array<int>")
    for r in sizes.select("a", pii.running(F.col("a")).alias("sums")).collect():
        assert r.sums == list(itertools.accumulate(r.a))


def planted(n, seed):
    """(text, end of the secret's span, secret) of texts with one secret each, in several forms, and texts with other codes."""
    rng = random.Random(seed)
    letters = string.ascii_letters + string.digits
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randrange(3, 9)))
    some = lambda k, of=letters: "".join(rng.choice(of) for _ in range(k))
    forms = [lambda: "AKIA" + some(16, string.ascii_uppercase + string.digits), lambda: "ghp_" + some(36), lambda: "sk-" + some(40), lambda: some(32, "0123456789abcdef"), lambda: some(40), lambda: some(90)]
    ahead = ["api_key=", "token: ", 'password = "', "secret=", "Bearer token: ", ""]
    out = []
    for i in range(n):
        before, after = " ".join(word() for _ in range(30)), " ".join(word() for _ in range(30))
        secret = forms[i % len(forms)]()
        mark = ahead[rng.randrange(len(ahead))]
        out.append((f"{before} {mark}{secret} {after}", secret))
        out.append((f"{before} order {rng.randrange(10**14, 10**15)} {word()}-{word()}-{rng.randrange(2000)} in {word()}_{rng.randrange(10**6)} {after}", None))
    return out


def test_planted_secrets_are_found(spark):
    """Recall and false finds over secrets of six forms with six kinds of context."""
    rows = planted(300, 3)
    got = {r.doc_id: r.spans for r in pii.personal_data(docs(spark, *((i, t) for i, (t, _) in enumerate(rows)))).collect()}
    found = clean = 0
    for i, (text, secret) in enumerate(rows):
        spans = [tuple(map(int, s.split(":")[1:])) for s in got[i].split(",") if s.startswith("secret")]
        if secret is None:
            clean += not spans
        else:
            found += any(text[a:b] == secret for a, b in spans)
    assert found >= 0.9 * 300 and clean >= 0.95 * 300, (found, clean)


def test_reliabilities_find_the_better_labeler():
    counts = {"++0": 100, "+-0": 10, "--0": 300, "-+0": 5, "000": 50}
    found = pii.reliabilities(counts)
    assert found["++0"] > 0.95 and found["--0"] < 0.05


def test_licenses(spark):
    mit, header = license_scan.TEMPLATES["MIT"], license_scan.TEMPLATES["MIT (permission)"]
    words = header.split()
    near = " ".join(words[:30] + ["really"] + words[30:])
    far = " ".join(w if i % 6 else "other" for i, w in enumerate(words))
    rows = [(1, "filler " * 333 + mit), (2, f"x {header} y {mit}"), (3, near), (4, far), (5, None), (6, "MIT License"), (7, LONG + header), (8, ""), (2, mit)]
    templates = spark.createDataFrame(list(license_scan.TEMPLATES.items()), "license string, text string")
    got = {(r.doc_id, r.license): (r.shared, r.total) for r in license_scan.scanned(docs(spark, *rows), templates).collect()}
    assert set(got) == {(1, "MIT"), (2, "MIT"), (2, "MIT (permission)"), (3, "MIT (permission)"), (7, "MIT (permission)")}
    assert got[2, "MIT (permission)"][0] == got[2, "MIT (permission)"][1] > got[3, "MIT (permission)"][0]
    with pytest.raises(ValueError):
        license_scan.scanned(docs(spark, *rows), spark.createDataFrame([("a", "too short")], "license string, text string"))


@pytest.mark.parametrize("most", [0, 20_000])
def test_license_library(spark, monkeypatch, most):
    monkeypatch.setattr(license_scan, "LISTED_BANDS", most)
    templates = spark.createDataFrame([*license_scan.TEMPLATES.items(), ("none", None)], "license string, text string")
    rows = docs(spark, *enumerate("x " * i + t for i, t in enumerate(license_scan.TEMPLATES.values())))
    got = license_scan.scanned(rows, templates).where("shared = total").collect()
    assert {(r.doc_id, r.license) for r in got} >= set(enumerate(license_scan.TEMPLATES))
    assert license_scan.scanned(rows.limit(0), templates).count() == 0 and license_scan.scanned(rows, templates.limit(0)).count() == 0


def test_bands_retrieve_by_themselves(spark):
    """Texts that hold 0.8 of a template share a band with it in some window of its class."""
    rng = random.Random(2)
    sets = {r.license: r for r in license_scan.classed(spark.createDataFrame(list(license_scan.TEMPLATES.items()), "license string, text string")).collect()}
    rows = []
    for name, r in sets.items():
        for _ in range(12):
            part = [x if i >= r.total // 5 else rng.getrandbits(62) for i, x in enumerate(r.shingles)]
            at = rng.randrange(2000)
            rows.append((name, r.net, [rng.getrandbits(63) - 2**62 for _ in range(at)] + part + [rng.getrandbits(62) for _ in range(3000)]))
    df = spark.createDataFrame(rows, "license string, net int, h array<bigint>")
    for net in {r.net for r in sets.values()}:
        keys = {x.license: set(x.b) for x in spark.createDataFrame([(k, r.shingles) for k, r in sets.items() if r.net == net], "license string, s array<bigint>").select("license", license_scan.bands(F.col("s"), net).alias("b")).collect()}
        got = df.where(F.col("net") == net).select("license", F.flatten(F.transform(license_scan.windows(F.col("h"), net), lambda w: w["bands"])).alias("b")).collect()
        assert len(got) >= 12 and all(keys[x.license] & set(x.b) for x in got)


def verdict(url, rules, default="allow"):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, default, None))
    return host, path, best[3], best[2]


URLS = ["http://a.example.org/en/12", "https://EXAMPLE.org/es/x?q#f", "http://x.org", "http://x.org/", None, "", "no scheme", "http://b.com/de/1#t", "http://com/fr/", "://", "a://b://c/d",
        "http://notorg/", "http://a.b.c.d.com/de/" + "x" * 5000, "http://x.org/a b\nc", "http://.org/"]


@pytest.mark.parametrize(("most", "lengths"), [(0, 1024), (100_000, 1024), (100_000, 2)])
def test_urls(spark, monkeypatch, most, lengths):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
    monkeypatch.setattr(url_filter, "LENGTHS", lengths)
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], "y"), (None, URLS[1], None)], "page_id long, url string, host string")
    rules = spark.createDataFrame([*queries.URL_RULES, ("block", None, "/")], "verdict string, host string, path string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages, rules).collect())
    assert got == Counter((i, *verdict(u, queries.URL_RULES)) for i, u in [*enumerate(URLS), (0, URLS[0]), (None, URLS[1])])


def test_urls_of_very_many_labels(spark):
    pages = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "com/de/x"), (2, "http://" + "b/" * 10_000)], "page_id long, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "verdict string, host string, path string")
    assert {r.page_id: r.rule for r in url_filter.judged(pages, rules).collect()} == {1: "com/de/", 2: None}


def test_urls_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, URLS[0])], "page_id long, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "verdict string, host string, path string")
    assert [r.verdict for r in url_filter.judged(pages, rules.limit(0), "block").collect()] == ["block"]
    assert url_filter.judged(pages.limit(0), rules).count() == 0


def test_mixing(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"), F.lit(0).alias("copy"))
    got = mixing.mixed(rows, {"a": 0.6, "b": 0.1, mixing.REST: 0.3}, seed=4)
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert n["a"] == pytest.approx(3600, rel=0.06) and n["b"] == pytest.approx(600, rel=0.15) and n[None] == pytest.approx(1800, rel=0.08)
    assert got.groupBy("doc_id").agg(F.countDistinct("copy").alias("d"), F.count("*").alias("n"), F.max("copy").alias("m")).where("d <> n or m <> n").count() == 0
    assert sorted(got.columns) == ["copy", "doc_id", "shuffle_key", "source", "text"]
    assert got.exceptAll(mixing.mixed(rows.repartition(7), {"a": 0.6, "b": 0.1, mixing.REST: 0.3}, seed=4)).count() == 0
    parts = got.groupBy(F.spark_partition_id().alias("p")).agg(F.avg((F.col("source") == "a").cast("int")).alias("a"), F.count("*").alias("n")).collect()
    assert all(abs(p.a - 0.75) < 0.15 for p in parts if p.n > 300)


def test_mixing_keeps_columns_of_any_name(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(7).alias("_times"), F.lit(None).alias("g"))
    got = mixing.mixed(rows, {"a": 1.0})
    assert set(got.columns) == {"doc_id", "source", "_times", "g", "copy", "shuffle_key"}
    assert got.where("_times = 7").count() == got.count() > 0 and got.agg(F.min("copy")).first()[0] == 1


def test_mixing_of_large_means_and_odd_tables(spark):
    rows = docs(spark, *((i, "x") for i in range(50)))
    got = mixing.mixed(rows, {"a": 1.0}, size=50 * 90).groupBy("doc_id").count()
    assert got.agg(F.avg("count")).first()[0] == pytest.approx(90, rel=0.1)
    assert got.agg(F.variance("count")).first()[0] == pytest.approx(90, rel=0.7)
    assert mixing.mixed(rows.limit(0), {"a": 1.0}).count() == 0
    assert mixing.mixed(docs(spark, (None, None), source=None), {mixing.REST: 1.0}, size=5).count() >= 0
    with pytest.raises(ValueError):
        mixing.mixed(rows, {"a": 0.0})


def test_long_secrets_are_candidates_to_their_end(spark):
    named, late = "aB3/+" * 100, "x" * 300 + "12345"
    table = docs(spark, (1, f"a token={named} b"), (2, f"{late} b"), (3, "x" * 300), (4, "token=" + "q/" * 50_000))
    got = table.select("doc_id", F.transform(pii.candidates(F.col("text"), pii.nothing()), lambda c: F.struct(c["start"], c["end"])).alias("c")).collect()
    got = {r.doc_id: {tuple(c) for c in r.c} for r in got}
    assert (8, 508) in got[1] and got[2] == {(0, 305)} and got[3] == set() and got[4] == {(6, 100_006)}
