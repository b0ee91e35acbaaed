"""The operators against brute force, and on nulls, empty and long texts,
ties, repeated rows, empty tables and clashing column names."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from tallyspark.llm import (mixing, ngram_join, quality_gam, queries, site_lines, surrogates, tag_paths, templates,
                            trie_tokens, warc, winnowing)
from llm_brute import brute_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
BASE = " ".join(f"word{i}" for i in range(60))
ODD = [(None, "a null id", "en", "s", 9), (1, None, "en", "s", 0), (2, "", None, None, 0), (3, LONG, "en", "s", len(LONG)),
       (4, BASE, "en", "s", len(BASE)), (5, BASE.upper(), "en", "t", len(BASE)), (5, BASE.upper(), "en", "t", len(BASE)),
       (6, BASE + " more", "en", "t", 1), (7, "two words", "en", "t", 9), (8, "two words", "en", "t", 9), (9, " \n\t ", "en", "t", 4)]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns named like the operators' own."""
    docs = spark.createDataFrame(ODD, DOCS)
    return docs.withColumn("token", F.lit(1)).withColumn("c", F.lit("x")).withColumn("key", F.lit(2)).withColumn("score", F.lit(0.1)).withColumn("label", F.lit(3))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_ngram_join(spark, odd, none, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(ngram_join.linked_components(docs).collect()) == order(brute_components([tuple(r) for r in docs.collect()]))
    assert order(ngram_join.linked_components(odd).collect()) == order(brute_components([r[:2] for r in ODD]))
    assert ngram_join.linked_components(none).count() == 0
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str) == [1, 2, 3, 4, 7, 9, None]
    clash = docs.limit(60).withColumn("_id", F.lit(1)).withColumn("_hash", F.lit(2)).withColumn("_copies", F.lit(3)).withColumn("label", F.lit(4)).withColumn("t", F.lit(5))
    kept = ngram_join.keep_one(clash)
    assert kept.columns == clash.columns and {(r["_id"], r["_hash"], r["_copies"], r.label, r.t) for r in kept.collect()} == {(1, 2, 3, 4, 5)}
    twin = spark.createDataFrame([(None, BASE), (8, BASE), (8, BASE), (None, "lone words"), (None, "lone words"), (9, "two"), (9, "three")], "doc_id long, text string")
    assert order(ngram_join.keep_one(twin).collect()) == order([(8, BASE), (None, "lone words"), (9, "two"), (9, "three")])


def test_coded_numbers():
    rng = np.random.default_rng(8)
    for values in (np.zeros(0, np.uint64), np.array([0], np.uint64), np.array([0, 0, 127, 128, 2 ** 60], np.uint64), np.sort(rng.integers(0, 2 ** 40, 999).astype(np.uint64))):
        assert ngram_join.decoded(ngram_join.coded(values)).tolist() == values.tolist()


def test_ngram_join_of_a_large_near_group(spark):
    words = [f"base{i}" for i in range(80)]
    rows = []
    for i in range(300):
        own = list(words)
        for j in range(i % 4):
            own[(i * 7 + j * 23) % 80] = f"new{i}x{j}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.linked_components(docs).collect())) == sorted(brute_components(rows))


def test_winnowing(spark, odd, none):
    rng = np.random.default_rng(5)
    for n in (0, 4, 10, 30, 49, 50, 300):
        text = "".join(rng.choice(list("ab é"), n))
        hashes, places = winnowing.winnow(text)
        grams = [int(winnowing.winnow(text[i:i + 10])[0][0]) for i in range(max(0, n - 9))]
        want = []
        for a in range(max(1, len(grams) - 39) if grams else 0):
            window = grams[a:a + 40]
            at = a + max(i for i, v in enumerate(window) if v == min(window))
            if not want or want[-1] != at:
                want.append(at)
        if grams:
            assert places.tolist() == want and hashes.tolist() == [grams[i] for i in want]
    assert winnowing.winnow("a" * 200)[1].tolist() == list(range(39, 191))  # rightmost of equal hashes
    passage = "".join(rng.choice(list("abcdefgh "), winnowing.K + winnowing.W - 1))
    a, b = (set(winnowing.winnow(x)[0].tolist()) for x in ("x" * 77 + passage + "y" * 50, "q" * 31 + passage))
    assert a & b
    got = {(r.doc_id, r.n_chars): r for r in winnowing.edited_pairs(odd).collect()}
    rows = sorted(((i, t or "") for i, t, *_ in ODD), key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len({(i, len(t)) for i, t in rows})
    for (i, t), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        if i != 5:
            assert got[i, len(t)].edited_sha256 == hashlib.sha256(winnowing.edited(t, after).encode()).hexdigest()
    assert got[8, 9].fingerprint == got[7, 9].fingerprint and got[8, 9].near_next == 1.0
    assert winnowing.edited_pairs(none).count() == 0
    assert winnowing.fingerprints(odd).count() == len(ODD)


def test_templates(spark, odd, none):
    items = [(1, "Anna pays 12.50 dollars for 3 kg of apples at Robert the grocer on this sunny day"), (2, None), (3, "too few"), (4, "just four plain words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    same = "Before. Today Maria pays 99 dollars for 7 kg of apples at Julia the grocer on this sunny day. After"
    wrong = "Then pays 12.50 dollars for 3 kg of pears at Robert in town. Nobody knows the rest of it"
    docs = odd.unionByName(spark.createDataFrame([(20, items[0][1], "", "", 0), (21, same, "", "", 0), (22, wrong, "", "", 0), (23, "so just four plain words here", "", "", 0)], DOCS), allowMissingColumns=True)
    found = {(r.doc_id, r.item_id): r.exact for r in templates.matches(docs, bench).collect()}
    assert found == {(20, 1): True, (21, 1): False, (23, 4): True}
    assert templates.drop_contaminated(docs, bench).count() == len(ODD) + 1
    twice = "He counts 5 red apples and buys 5 more red apples then eats 2 of the red apples today"
    bench = spark.createDataFrame([(1, twice)], "item_id long, text string")
    docs = spark.createDataFrame([(1, twice.replace("5", "8")), (2, twice.replace("5", "8", 1))], "doc_id long, text string")
    wrong_only = {r.doc_id for r in templates.matches(docs, bench).collect()}
    assert wrong_only == {1}  # one value of the item stands for two values of document 2
    assert templates.matches(none, bench).count() == 0
    assert templates.matches(odd, bench.limit(0)).count() == 0


def test_trie_tokens(spark, odd, none, small_dir):
    pieces, byte = trie_tokens.load_pieces()
    longest = max(map(len, pieces))
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").limit(60).collect()
    docs += [(1000, "x" * 500 + " 漢字 ☃ naïve"), (1001, None), (1002, "")]
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in trie_tokens.token_counts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert got[i] == (len(words), sum(trie_tokens.cut(trie_tokens.MARK + w, pieces, byte, longest) for w in words))
    assert trie_tokens.token_counts(odd).count() == len(ODD) and trie_tokens.token_counts(none).count() == 0


def test_long_words_go_through_the_trie(spark):
    pieces, byte = trie_tokens.load_pieces()
    longest = max(map(len, pieces))
    rng = np.random.default_rng(5)
    han = "".join(chr(c) for c in rng.integers(0x4E00, 0x9FA5, 3000))
    thai = "".join(chr(c) for c in rng.integers(0x0E01, 0x0E2F, 3000))
    mixed = "".join(rng.choice(["the", "漢字", "ing", "☃", "number", "é"], 600))
    base64ish = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/"), 3000))
    docs = [(i, w) for i, w in enumerate((han, thai, mixed, base64ish, han[:100] + " " + han, "a" * 200, "\U0001F600" * 100))]
    trie = trie_tokens.TrieCounter(pieces, byte)
    assert all("".join(trie.parts(w)) == w for _, w in docs)
    assert max(map(len, trie.parts(trie_tokens.MARK + han))) <= trie_tokens.WIDE
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in trie_tokens.token_counts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: (len(t.split()), sum(trie_tokens.cut(trie_tokens.MARK + w, pieces, byte, longest) for w in t.split())) for i, t in docs}


def test_tag_paths(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site name</header><nav><ul><li><a href=x>Home</a></ul></nav>
    <div class="ad">Buy now, really. Good.</div><main><h1>A&amp;B  title</h1><p>First <b>bold</b>
    para, with text. More text, and more.<p>Second &eacute;t&eacute; para, also long enough.<ul><li>An item, too.</ul>
    <script>var a = "</p>";</script><form><input> Send</form><div class="comments"><p>I like it, a lot.</p></div></main>
    <aside>Other things.</aside><footer>(c) 2024</footer>"""
    assert tag_paths.extract(page) == "A&B title\n\nFirst bold para, with text. More text, and more.\n\nSecond été para, also long enough.\n\nAn item, too."
    assert tag_paths.extract(None) == tag_paths.extract("") == tag_paths.extract("<!-- <p>x</p>") == ""
    assert tag_paths.extract("plain text only") == "plain text only"
    rows = spark.createDataFrame([(1, None, None, "x"), (None, "u", page, "x"), (1, "u", "<p>a.<p>b.", "y")], "page_id long, url string, html string, text string")
    got = tag_paths.extract_pages(rows).collect()
    assert [r.n_chars for r in got] == [len(r.text) for r in got] and got[2].text == "a.\n\nb."
    assert tag_paths.extract_pages(rows.limit(0)).count() == 0


def test_warc(spark):
    long = "é" * 100_000
    rows = [(1, "u1", "same"), (2, "u2", "same"), (3, "u3", None), (4, None, ""), (5, "u5", long), (None, "u6", "same"), (7, "u\r\n7", "x"), (7, "u7", "x")]
    rows += [(100 + i, f"u{i}", f"<p>page {i} of many pages</p>" * 30) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    got = warc.archived(pages).collect()
    assert len(got) == len(rows)
    best = {}
    for i, _, t in rows:
        best[t or ""] = max(best.get(t or "", -1), i or -1)
    want = sorted(((i, len((t or "").encode()), warc.base32_sha1((t or "").encode()), "response" if best[t or ""] == i else "revisit", None if best[t or ""] == i else best[t or ""]) for i, _, t in rows), key=repr)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == want
    few = warc.archived(pages, min_bytes=5).where("payload_bytes < 5").select("record_type").distinct().collect()
    assert [r[0] for r in few] == ["response"]
    assert warc.archived(pages.limit(0)).count() == 0


def test_warc_reads_only_archives_of_the_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4096)  # records above an archive's size, several archives a task
    pages = spark.createDataFrame([(i, f"u{i}", f"page {i} " * (2000 if i % 10 == 0 else 5)) for i in range(60)], "page_id long, url string, html string")
    folder = f"{tmp_path}/archives"
    index = warc.write_archives(pages, folder)
    first = {r.file for r in index.collect()}
    assert len(first) > 8
    again = warc.write_archives(pages, folder)  # as an attempt that did not count: same folder, other names
    assert not first & {r.file for r in again.collect()}
    (tmp_path / "archives" / "pages-000000-half-00000.warc.zst").write_bytes(b"cut")
    got = {r.page_id: r.payload.decode() for r in warc.read_archives(index, folder).collect()}
    assert got == {r.page_id: r.html for r in pages.collect()}
    assert warc.read_archives(index, folder).count() == 60
    with pytest.raises(Exception, match="records, .* are listed"):
        warc.read_archives(index.withColumn("records", F.col("records") + 1), folder).collect()


def test_archive_round_trip():
    records = [warc.record(i, f"http://x/{i}", f"payload {i} ".encode() * 50, "D", None) for i in range(100)]
    data = warc.archive_bytes(records)
    assert int.from_bytes(data[:4], "little") == warc.MAGIC
    assert [b for _, b in warc.records_of(data)] == [r.split(b"\r\n\r\n", 1)[1][:-4] for r in records]
    assert len(list(warc.records_of(warc.archive_bytes(records[:2])))) == 2


def test_quality(spark, odd, none, small_dir):
    sf = small_dir.replace("sf0.001", "sf0.01")
    got = queries.op9_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, None), (6, 5), (None, 1)], "doc_id long, quality int")
    model = quality_gam.train(odd, labels)
    assert quality_gam.with_score(odd, model).where("_score between 0 and 1").count() == len(ODD)
    for empty in (quality_gam.train(odd, labels.limit(0)), quality_gam.train(none, labels)):
        assert {r._score for r in quality_gam.with_score(odd, empty).collect()} == {0.5}
    assert quality_gam.with_score(none, model).count() == 0


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert ((model.score(x) >= 0.5) == (y == 1)).mean() > 0.97


def test_site_lines(spark, none):
    rows = [(i, f"Shared line\n\nown {i}\n Shared line", "en", None if i % 2 else "s", 1) for i in range(40)] + [(90, "Shared line", "en", "s", 1), (91, None, "en", "s", 0), (92, "", "en", "s", 0)]
    rows += [(200 + i, "copied whole\nagain", "en", "t", 1) for i in range(30)] + [(300 + i, f"x {i}", "en", "t", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("line", F.lit(0)).withColumn("bad", F.lit(0))
    got = {r.doc_id: (r.text, r._dropped) for r in site_lines.drop_site_lines(docs).collect()}
    assert got[0] == ("\nown 0", 2) and got[1] == ("\nown 1", 2)
    assert got[90] == ("Shared line", 0) and got[91] == (None, 0) and got[92] == ("", 0)
    assert got[200] == ("copied whole\nagain", 0)  # copies of one page are one page
    assert site_lines.drop_site_lines(none).count() == 0


def test_mixing(spark, odd, none):
    rows = [(i, "w " * (5 + i % 7), "en", "big" if i % 10 else "small", 0) for i in range(3000)] + [(5000, None, "en", "nothing", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("part", F.lit(0)).withColumn("tokens", F.lit(0))
    got = mixing.mix(docs, target=0.9, block_words=300).groupBy("source").agg(F.sum("_words").alias("n"), F.max("_epoch").alias("e")).collect()
    sums = {r.source: r.n for r in got}
    total = sum(len(r[1].split()) for r in rows if r[1])
    p = np.array([sums["big"], sums["small"]]) / sum(sums.values())
    assert abs(sum(sums.values()) - total) < 60 and abs(-(p * np.log(p)).sum() / np.log(2) - 0.9) < 0.01
    few = mixing.mix(docs, target=1.0, max_repeats=2.0).where("source = 'small'").agg(F.max("_epoch")).first()[0]
    assert few <= 3
    assert mixing.mix(odd).columns[:len(odd.columns)] == odd.columns and mixing.mix(none).count() == 0


def test_surrogates(spark, odd, none):
    text = ("Mr. John Smith met Mrs. Anna Smith. MR. JOHN SMITH wrote to a.b@mail.example.com and A.B@Mail.example.com, +1 (578) 555-6437, "
            "+1 578 555 6437, 10.0.0.7, 8.8.8.8, 4111 1111 1111 1111, 4111111111111111, password=abc123XYZ, Г-жа Анна Петрова, 2024-01-02, 1,200.")
    new, n = surrogates.rewrite(text, b"k", {})
    assert n == 13 and "2024-01-02, 1,200." in new
    for gone in ("John", "Smith", "SMITH", "mail.example", "555-6437", "8.8.8.8", "4111", "abc123XYZ", "Петрова"):
        assert gone not in new
    mails = re.findall(r"\S+@\S+[a-z]", new)
    assert mails[0] == mails[1]
    phones = re.findall(r"\+1[ ()\d-]+\d", new)
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", new)
    assert cards[0].replace(" ", "") == cards[1] and surrogates._luhn(cards[1]) == 0
    him, her = re.search(r"Mr\. (\w+) (\w+)", new), re.search(r"Mrs\. (\w+) (\w+)", new)
    assert him[2] == her[2] and him[1] in surrogates.GIVEN["latin", "m"] and her[1] in surrogates.GIVEN["latin", "f"]
    rows = [(i, f"Mr. {chr(65 + i % 26)}{'abcdefgh'[i // 26]}n Doe, x{i}@a.org", "en", "s", 0) for i in range(150)]
    out = surrogates.pseudonymise(spark.createDataFrame(rows, DOCS)).collect()
    assert len({r.text.split(",")[0] for r in out}) == 150 and len({r.text.split(",")[1] for r in out}) == 150
    got = surrogates.pseudonymise(odd)
    assert got.columns == [*odd.columns, "_entities"] and {r.text for r in got.collect()} == {r[1] for r in ODD}
    assert surrogates.pseudonymise(none).count() == 0


def test_surrogates_of_secrets_without_digits():
    secrets = ("password = hunterhunter", "api_key: abcdefghij", "Token=correcthorse", "sk_live_" + "abcdefgh" * 2, "AKIA" + "ABCDEFGH" * 2, "ghp_" + "abcdefghi" * 4)
    for secret in secrets:
        alone, n = surrogates.rewrite(f"use {secret} here", b"k", {})
        other, m = surrogates.rewrite(f"use {secret} here 7", b"k", {})
        assert n == m == 1 and re.split("[ =_]+", secret)[-1] not in alone and other == alone + " 7"


def test_surrogates_of_later_mentions():
    def units(text):
        return [u for *_, us in surrogates.entities(text) for u in us]

    text = "Mr John Smith met Dr Maria Jones. Smith said, and SMITH's Smith-led team with John Smith agreed; Jones left. Blacksmith, smith."
    new, n = surrogates.rewrite(text, b"k", {})
    assert n == 7 and not re.search(r"John|Smith|SMITH|Maria|Jones", new) and new.endswith("Blacksmith, smith.")
    him, her = re.match(r"Mr (\w+) (\w+) met Dr (\w+) (\w+)", new).groups()[1::2]
    assert f". {him} said, and {him.upper()}'s {him}-led" in new and f"; {her} left" in new
    assert ("given", "f:latin:maria") in units("Dr Maria Smith")
    assert units("Mr John Smith") == units("Dr John Smith") == units("yesterday John Smith left")
    assert units("Dr Zorg Smith and Mr Zorg Smith") == units("Mr Zorg Smith and Mr Zorg Smith")
    assert units("Mr Smith The Mrs Jones") == [("surname", "n:latin:smith"), ("surname", "n:latin:jones")]
    assert units("Anna The Great; John; Smith said; Miss You") == []


def test_templates_of_numbers_names_and_unspaced_scripts(spark):
    items = [(1, "Compute 3 + 4 * 12 / 6"), (2, "Then Anna has 3 apples, Bob has 4 pears, Carl has 5 plums, Dora has 6 figs"),
             (3, "小明有12个苹果，他给了小红3个苹果，他还剩下多少个苹果？"), (4, "แม่ซื้อส้มห้าผลและกินไปสองผล"), (5, "北京大学"), (6, "Add 1 2 3 and Ohio 4 5 Utah 6 7 8")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, f"Some words before. {t} Some words after.") for i, t in items if i != 5]
    docs += [(12, "Then Mary has 8 apples, Paul has 9 pears, Hugo has 2 plums, Nora has 7 figs"), (13, "问题：小明有80个苹果，他给了小红5个苹果，他还剩下多少个苹果？谢谢。"),
             (15, "他在北京大学学习"), (21, "Compute 3 + 4 * 12 / 7"), (23, "小明有12本书，他还想买多少本"), (24, "nothing of this kind stands here")]
    found = {(r.doc_id, r.item_id): r.exact for r in templates.matches(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert found == {(1, 1): True, (2, 2): True, (12, 2): False, (3, 3): True, (13, 3): False, (4, 4): True, (6, 6): True}


def test_surrogates_of_crowded_kinds(spark, monkeypatch):
    held = spark.range(40_000).select(F.lit("ip").alias("kind"), F.format_string("192.168.%d.%d", F.floor(F.col("id") / 256), F.col("id") % 256).alias("unit"))
    found = {r.unit: r.attempt for r in surrogates.attempts_needed(held, b"k").collect()}
    real = {r.unit for r in held.collect()}
    made = {surrogates.surrogate(b"k", "ip", u, found.get(u, 0)) for u in real}
    assert len(made) == 40_000 and not made & real and {m.split(".")[0] for m in made} == {"10", "192"}
    monkeypatch.setattr(surrogates, "ATTEMPTS", 2)
    full = spark.range(10).select(F.lit("card").alias("kind"), F.format_string("4%d", "id").alias("unit"))
    with pytest.raises(RuntimeError, match="10 of kind card"):
        surrogates.attempts_needed(full, b"k")
