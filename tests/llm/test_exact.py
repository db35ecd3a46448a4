"""The training-data operators against brute force on small frames with nulls, empties, ties and repeats."""

import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from conftest import SF_DIR
from flowtide.llm import decontaminate, html_text, jaccard_join, license_scan, packing, pii, quality, queries, topk, url_filter, warc
from flowtide.llm.components import components

tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, rid string"


@pytest.fixture(scope="module")
def docs(spark):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(1, base), (2, base), (2, base), (3, base.replace("word7 ", "other ")), (4, None), (5, ""), (None, "a b"), (6, "a  b\n\n\t c "),
            (7, "q " * 5000), (8, base + " tail tail"), (9, "one two three")]
    return spark.createDataFrame([(i, t, "en", "x") for i, t in rows], DOCS)


@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.ENTRIES.items() if sql])
def test_queries_match_their_sql(spark, name):
    query, sql = queries.ENTRIES[name]
    assert oracle.compare(spark, oracle.connect(SF_DIR), query, sql, SF_DIR) is None


def test_packing_cuts_every_id_once(spark, docs):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    marked = [(20, "a<|endoftext|>b"), (21, "<|endoftext|><|endoftext|> x <|endoftext"), (22, "x <|endoftext|>\n" * 50)]
    docs = docs.union(spark.createDataFrame([(i, t, "en", "x") for i, t in marked], DOCS))
    pieces = packing.pack(docs, *queries.byte_vocabulary(), window=64).collect()
    want = Counter()
    for r in docs.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [0]
        want[(r.doc_id, len(ids))] += len(ids)
    got = Counter()
    for p in pieces:
        got[(p.doc_id, p.doc_tokens)] += p.length
    assert got == want
    texts = {r.doc_id: np.array(plain.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4") for r in docs.collect()}
    assert all(zlib.crc32(texts[p.doc_id][p.start:p.start + p.length].tobytes()) == p.ids_crc32 for p in pieces)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(sum(n for _, n in parts) < 64 for parts in sequences.values()) <= 1


def test_packing_of_nothing(spark, docs):
    assert packing.pack(docs.limit(0), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).count() == 0


def _near(rows):
    pattern = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
    sets = []
    for _, text in rows:
        w = pattern.findall((text or "").lower())
        k = min(5, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return links, [find(a) for a in range(len(rows))]


@pytest.mark.parametrize("block", [1500, 2])
def test_join_matches_all_pairs(spark, docs, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(150)]
    near = [" ".join(w if rng.random() > 0.01 else "new" for w in words) for _ in range(12)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(100 + i, t) for i, t in enumerate(near)]
    frame = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows)], "rid long, doc_id long, text string")
    got = {r.rid: r for r in jaccard_join.near_duplicates(frame).collect()}
    links, roots = _near(rows)
    assert [got[k].n_links for k in range(len(rows))] == links
    assert len(got) == len(rows) == len({k for k in got})
    classes = defaultdict(set)
    for k in range(len(rows)):
        classes[got[k].first_rid].add(k)
    want = defaultdict(set)
    for k, r in enumerate(roots):
        want[r].add(k)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_pruning_keeps_pairs_that_can_reach_the_threshold():
    assert jaccard_join.least_matches(24) < 0.8 * 24
    assert sum(math.comb(25, m) * 0.8 ** m * 0.2 ** (25 - m) for m in range(jaccard_join.least_matches(24))) < jaccard_join.TOLERANCE


@pytest.mark.parametrize("parts", [1, 7])
def test_bucket_links_of_any_size(spark, monkeypatch, parts):
    """Buckets within a partition, at its ends, and over several partitions."""
    monkeypatch.setattr(jaccard_join, "partitions", lambda _: parts)
    rows = [(i, 5) for i in range(400)] + [(i, 9) for i in (1000, 1001)] + [(i, -i) for i in range(300)] + [(2000, 7), (3, 9)]
    frame = spark.createDataFrame(rows, "rid long, band long")
    got = {r.node: r.root for r in components(jaccard_join.bucket_links(frame)).collect()}
    assert got == {**dict.fromkeys(range(400), 0), 1000: 0, 1001: 0}
    assert jaccard_join.bucket_links(frame.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


def test_contamination_by_hand(spark):
    item = " ".join(f"t{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"x {item.upper()}, y", 0), (2, item.replace("t5", "no"), 0), (3, None, 0), (4, "", 0), (5, "short item. short item", 0), (5, "short item", 0)], "doc_id long, text string, start int")
    items = spark.createDataFrame([(10, item), (9, item), (11, "Short, item"), (12, None), (13, "!"), (None, "x"), (14, "absent words")], "item_id long, text string")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(rows, items).collect())
    assert got == [(1, 14, 13, 3, True), (2, 12, 0, 0, False), (3, 0, 0, 0, False), (4, 0, 0, 0, False), (5, 2, 2, 1, True), (5, 4, 4, 1, True)]
    assert decontaminate.contamination(rows, items.limit(0)).filter("contaminated").count() == 0


def test_contamination_by_items_without_an_id(spark, tmp_path):
    """The query's own SQL on tables with such items."""
    docs = [(1, "one two three four"), (2, "two"), (3, None), (4, "five six")]
    items = [(None, "two three"), (None, "four"), (7, "two"), (8, "two three")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = oracle.duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert oracle.compare(spark, con, queries.op6_decontamination, queries.OP6_SQL, str(tmp_path)) is None
    assert {r.doc_id: (r.n_hit, r.n_items) for r in queries.op6_decontamination(spark, str(tmp_path)).collect()} == {1: (3, 3), 2: (1, 1), 3: (0, 0), 4: (0, 0)}


def test_proximity(spark):
    docs = spark.createDataFrame([(0, 1, "alpha gap beta"), (1, 2, "alpha gap gap gap beta")], "rid long, doc_id long, text string")
    windows, _ = decontaminate.test_windows(spark.createDataFrame([(1, "alpha beta")], "item_id long, text string"))
    postings, terms = decontaminate.build_index(docs, windows)
    assert [r.rid for r in decontaminate.occurrences(postings, terms, windows, slop=1).collect()] == [0]
    assert decontaminate.occurrences(postings, terms, windows).count() == 0


def test_surrogates(spark):
    rows = [(1, "Mail Bob.Smith@corp.example.com or bob.smith@corp.example.com, +1 (017) 555-7713 / +1 017 555 7713"), (2, "Mr. John Smith, Mrs Smith; 4111 1111 1111 1111 10.0.0.1"),
            (3, None), (4, ""), (5, "г-н Иван Петров 4111-1111-1111-1111!"), (6, "clean 1234, v3.0")]
    frame = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, entities int")
    out = {r.doc_id: r for r in pii.pseudonymized(frame, "k").collect()}
    assert out[3].text is None and out[4].text == "" and out[6].text == rows[5][1] and out[6].entities == 7
    mails = re.findall(r"\S+@\S+\.com", out[1].text)
    assert len(mails) == 2 and mails[0] == mails[1] and "corp" not in mails[0]
    assert re.search(r"\+\d \(\d{3}\) \d{3}-\d{4} / \+\d \d{3} \d{3} \d{4}$", out[1].text)
    phones = [re.sub(r"\D", "", p) for p in re.findall(r"\+[\d ()-]+", out[1].text)]
    assert phones[0] == phones[1] != "10175557713"
    card = re.search(r"(?:\d{4} ){3}\d{4}", out[2].text)[0]
    assert card.replace(" ", "-") in out[5].text and not card.startswith("4111")
    digits = [int(c) for c in card if c != " "]
    assert sum(sum(divmod(d * 2, 10)) if k % 2 == 0 else d for k, d in enumerate(digits)) % 10 == 0
    names = re.match(r"Mr\. (\w+) (\w+), Mrs (\w+);", out[2].text)
    assert names[2] == names[3] != "Smith" and re.match(r"г-н [А-Я][а-я]+ [А-Я][а-я]+ ", out[5].text)
    assert pii.pseudonymized(frame, "k2").filter("doc_id = 2").first().text != out[2].text


def test_account_numbers_of_all_lengths(spark):
    ibans = ["DE89370400440532013000", "GB29NWBK60161331926819", "FR7630006000011234567890189", "NL91ABNA0417164300", "IT60X0542811101000000123456", "NO9386011117947", "ES9121000418450200051332", "MT84MALT011000012345MTLCAST001S"]
    rows = [(i, f"{n} / {' '.join(n[k:k + 4] for k in range(0, len(n), 4))} FOR 12") for i, n in enumerate(ibans)]
    rows += [(100, "NO12 THIS THAT THE and DE89 ONLY TEXT IN CAPS HERE IS"), (101, "ghp_" + "aB" * 20), (102, "ghp_" + "Ab" * 20)]
    out = {r.doc_id: r for r in pii.pseudonymized(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, n in enumerate(ibans):
        compact, spaced = out[i].text.removesuffix(" FOR 12").split(" / ")
        assert out[i].n_entities == 2 and compact == spaced.replace(" ", "") and compact[:2] == n[:2] and len(compact) == len(n)
        assert compact != n and " ".join(compact[k:k + 4] for k in range(0, len(n), 4)) == spaced and out[i].text.endswith(" FOR 12")
    assert out[100].n_entities == 0 and out[100].text == rows[-3][1]
    assert out[101].text.lower() != out[102].text.lower()


def test_check_digits_of_account_numbers(spark):
    remainder = lambda n: int("".join(str(int(c, 36)) for c in n[4:] + n[:4])) % 97
    rows = [(1, "DE89370400440532013000"), (2, "GB29NWBK60161331926819"), (3, "DE88370400440532013000")]
    out = {r.doc_id: r.text for r in pii.pseudonymized(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert remainder(out[1]) == remainder(out[2]) == 1 and all(out[i] != n for i, n in rows)


def test_bare_numbers_that_are_no_cards(spark):
    texts = ["at 1714557600123 it", "ISBN 9780306406158", "order 1000000000000001", "card 4111111111111112", "card 9999999999999995", None, ""]
    out = pii.pseudonymized(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert [r.n_entities for r in out] == [0, 0, 0, 1, 1, 0, 0] and all((r.text == t) == (not r.n_entities) for r, t in zip(out, texts))


def test_entities_within_long_tokens(spark):
    """Hosts of many labels, long runs of letters, and addresses that follow one another."""
    texts = ["a@" + "b." * 2500 + "com", "x" * 500_000 + "1", "a@" * 200_000, "f" * 100_000 + " 1", "a@b.com_x@y.org", "1" * 500_000, "m@" + "b." * 100 + "com", "a.b@c.de.f1 ü.ö@x-y.org"]
    out = pii.pseudonymized(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert [r.n_entities for r in out] == [0, 0, 0, 1, 2, 1, 1, 2]
    assert len(out[3].text) == len(texts[3]) and "x@y" not in out[4].text and out[7].text.split()[0].endswith(".de.f1")


def test_clashing_surrogates_move_on(spark):
    found = spark.createDataFrame([("ip", f"10.0.0.{i}") for i in range(5)], "kind string, norm string")
    made = found.select("kind", pii.surrogate("k", F.col("kind"), F.col("norm"), F.lit(0)).alias("norm")).limit(1)
    moved = pii.collisions(found.union(made), "k").collect()
    assert len(moved) == 1 and moved[0].attempt == 1


def test_quality_on_held_out_rows(spark):
    got = queries.op5_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 80 and (got.predicted == got.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_quality_without_labels_or_texts(spark, docs):
    described = quality.describe(docs)
    model = quality.fit(described, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.scores(described, model).collect()} == {0.5}
    assert quality.scores(quality.describe(docs.limit(0)), model).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.filter(F.xxhash64("key") % 7 == 0)
    cascade = url_filter.BloomCascade(listed, universe)
    got = {r.key for r in universe.filter(cascade.contains(F.col("key"))).collect()}
    assert got == {r.key for r in listed.collect()} and len(cascade.levels) > 1


def test_urls_by_hand(spark):
    urls = [("http://EXAMPLE.org/en/12?x", "example.org/en/1", "block"), ("x://notexample.org/en/1", "org/", "allow"), ("no url", None, "allow"), (None, None, "allow"), ("", None, "allow"),
            ("http://a.com/de/", "com/de/", "block"), ("http://com", None, "allow"), ("http://org#/", None, "allow"), ("http://x.example.org/es/", "example.org/es/", "block"), ("http://net/ü?", None, "allow")]
    pages = spark.createDataFrame([(i, u, "h") for i, (u, *_) in enumerate(urls)], "page_id long, url string, host string")
    got = url_filter.judge(pages, url_filter.rules_frame(spark, queries.URL_RULES)).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [x[1:] for x in urls]
    assert url_filter.judge(pages.limit(0), url_filter.rules_frame(spark, [])).count() == 0


def test_top_k_with_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(150)] + [(200, None), (300, [1.0, None]), (400, [float("nan")] * 6), (500, []), (600, [float("inf")] * 6), (700, [1.0] * 6), (700, [1.0] * 6), (701, [1.0] * 6), (701, [1.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    usable = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, (q, a) in enumerate(usable):
        if q % 100 == 0:
            best = sorted(((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(usable) if m != n))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 100 == 0).collect())
    assert got == sorted(want)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_archive_round_trip(spark, tmp_path):
    long = "ä" * 80
    rows = [(3, "http://a/", long), (1, "http://b/", long), (1, None, long), (2, "u", None), (4, "u", ""), (None, "u", long), (5, "x\r\ny", "line\r\n\r\nline")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    warc.write(pages, str(tmp_path / "a"))
    got = warc.read(spark, str(tmp_path / "a")).collect()
    assert Counter((r.page_id, bytes(r.payload)) for r in got) == Counter((i, (h or "").encode()) for i, _, h in rows)
    assert Counter(r.record_type for r in got if r.payload_bytes == 160) == {"response": 1, "revisit": 3}
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {1}
    assert spark.read.parquet(str(tmp_path / "a" / "payloads")).count() == 3
    warc.write_files(spark, str(tmp_path / "a"), str(tmp_path / "files"))
    assert spark.read.text(str(tmp_path / "files"), wholetext=True).count() >= 1


def test_archive_of_rows_without_an_id(spark, tmp_path):
    pages = spark.createDataFrame([(None, "a", "p" * 200), (None, "b", "p" * 200)], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "a"))
    got = warc.read(spark, str(tmp_path / "a")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(None, "response", None), (None, "revisit", None)]


def test_rendering():
    page = ("<h1>T</h1><p>a<p>b <b>c</b> d<ul><li>x<li>y<ol><li>1<li>2</ol></ul><table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td>kiwi fruit<td>12</table>"
            "<div hidden>no</div><div style='display: none'>no</div>z<br>w<pre> a\n  b</pre><script>x<p></script>end <3 & &lt;tag> <!-- c --> fin")
    assert html_text.rendered(page) == ("T\n\na\n\nb c d\n\n- x\n- y\n\n  1. 1\n  2. 2\n\nName        Qty\napple       3\nkiwi fruit  12\n\nz\nw\n\n a\n  b\n\nend <3 & <tag> fin")
    assert [html_text.rendered(p) for p in (None, "", "<", "<p", "</p>", "<!-- open", "<script>x")] == ["", "", "<", "<p", "", "", ""]
    assert html_text.rendered("<div>" * 3000 + "deep") == "deep"


def test_rendering_of_all_visible_text():
    assert all(html_text.rendered(f"<{tag}>" * 3000 + "<p>a</p><p>b<br>c</p><ul><li>d<li>e</ul>") == "a\n\nb\nc\n\n- d\n- e" for tag in ("div", "font"))
    assert html_text.rendered("<table><tr><td>" * 400 + "x<td>y</table>") == "x  y"
    assert html_text.rendered("<table><tr>stray &amp; <b>bold</b><td>a<td>b</table>") == "stray &\nbold\na  b"
    assert html_text.rendered("<table><tr><form><td>a<td>b</form></table>") == "a  b"
    shown = "<textarea>\nt &lt;\n u</textarea><select><option>o1<option>o2</select><object>f</object><svg><title>no</title><text>s</text></svg><dialog open>d</dialog><xmp><b></xmp><math><mi>m</mi></math>"
    assert html_text.rendered(shown) == "t <\n u\no1\no2\nf\ns\nd\n<b>\nm"
    assert html_text.rendered("<dialog>no</dialog><noscript>no</noscript><iframe>no</iframe>yes") == "yes"
    assert html_text.rendered("<p>a" + "<b>" * 10 + "<h1>x</h1>") == "a\n\nx"
    assert html_text.rendered("<table><tr><td colspan=2>wide title<td>z<tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e</table>") == "wide title  z\na  b        c\n   d        e"
    assert html_text.rendered("<table><tr><td colspan=0>a<td colspan=x>b<td rowspan=99999999>c</table>") == "a  b  c"
    assert html_text.rendered(f"a&#{'9' * 6000};b &#{'0' * 5000}65; &#{'0' * 5000};") == "a\ufffdb A \ufffd"
    assert html_text.rendered("<head><title>no</title><body>x") == html_text.rendered("<head><meta>x") == "x"


@pytest.mark.parametrize("page", ["<a " * 300_000, "<a " * 300_000 + ">", "<a \"" * 200_000 + ">", "<a \"<b '" * 100_000 + ">", "<b>" * 200_000 + "</i>" * 200_000,
                                  "<ul>" + "<b>" * 100_000 + "<li></li>" * 100_000, "<!" * 300_000, "<a" * 300_000 + "/ \"", "<b>x</b> " * 100_000, "<td colspan=1000>" * 1000])
def test_rendering_of_broken_megabytes(page):
    start = time.monotonic()
    html_text.rendered(page)
    assert time.monotonic() - start < 30


def test_lower_words_are_the_words_of_the_pattern(spark):
    import random

    from flowtide.llm.common import WORD_PATTERN, lower_words
    pick = random.Random(3)
    signs = [chr(c) for c in range(128)] * 2 + list("ÉßİΣ中\u2581\u00a0\u2028😀\U0001F1E9")
    texts = ["".join(pick.choices(signs, k=pick.randrange(60))) for _ in range(400)] + ["", " ", "A", "\x00A\x7Fb", "\n" * 50]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").select("text", lower_words(F.col("text")).alias("w"))
    for text, got in frame.collect():
        assert got == [w.translate(lower) for w in re.findall(WORD_PATTERN, text or "")]


def test_license_sample_is_not_filled_by_one_text(spark):
    """A text that makes up nearly all rows counts once in the sample."""
    docs = spark.createDataFrame([(i, "the same line") for i in range(3000)] + [(i, f"line {i} of its own") for i in range(40)], "doc_id long, text string")
    assert license_scan._sampled(docs, 10_000).count() == 41
    assert license_scan._sampled(docs.limit(0), 10).count() == 0


def test_license_scan(spark):
    docs = spark.createDataFrame([(1, "clean words here\nReleased under the MIT License.", 1), (2, None, 1), (3, "", 1), (4, "the licence of a driver is not here", 1), (5, "This work is licensed under the GNU General Public License, version 3.", 1)], "doc_id long, text string, family int")
    got = {(r.doc_id, r.paragraph, r.family) for r in license_scan.scan(docs).collect() if r.confirmed}
    assert got == {(1, 1, "MIT"), (5, 0, "GPL")}


def test_license_scan_of_a_long_line(spark):
    """A line of thousands of words is cut into words once."""
    import time
    docs = spark.createDataFrame([(i, " ".join(f"w{j % 700}" for j in range(20_000)) + " Released under the MIT License.") for i in range(4)], "doc_id long, text string")
    began = time.monotonic()
    license_scan.scan(docs).collect()
    assert time.monotonic() - began < 120


def test_license_scan_of_wrapped_and_cut_notices(spark):
    import textwrap
    wrapped = "\n".join(" * " + x for x in textwrap.wrap(license_scan.TEMPLATES[1][1], 76))
    docs = spark.createDataFrame([(1, f"some text here\n\n{wrapped}\n\nmore text there"), (2, "under the terms of the GNU Lesser General Public"), (3, "nothing to see in this text")], "doc_id long, text string")
    got = license_scan.scan(docs).collect()
    assert (1, 2, "GPL") in {(r.doc_id, r.paragraph, r.family) for r in got if r.confirmed}
    assert (2, 0) in {(r.doc_id, r.paragraph) for r in got} and 3 not in {r.doc_id for r in got}


def test_license_lines_hold_all_grams_of_their_run(spark):
    """Grams of the lines, and those across their ends, are the grams of the run, unless the next words are not all known."""
    texts = ["a b c\nd\ne f\n\n \t\ng h\n--\ni j k", "one\ntwo\nthree\nfour\nfive", "x y\n" + "w" * 90 + " v\nz", "a\n-\n-\n-\n-\nb c", "p q " * 40 + "\nr", "", " \n \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    grams = lambda t: {" ".join(t[i:i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    lines, loose = defaultdict(set), set()
    for r in license_scan._lines_ahead(docs).filter("in_run").collect():
        lines[r.rid, r.run] |= grams(r.t) | set(r.cross)
        if r.loose:
            loose.add((r.rid, r.run))
    runs = [(r.rid, grams(r.t)) for r in license_scan.paragraphs(docs).filter("n_lines > 1").withColumn("t", license_scan.lower_words(F.col("content"))).collect()]
    assert {rid for rid, _ in loose} == {2, 3} and len(runs) == 6
    for rid, want in runs:
        assert rid in {2, 3} or any(k[0] == rid and found == want for k, found in lines.items())


def test_license_scan_leaves_out_only_texts_without_a_find(spark):
    import textwrap
    prose = [f"The weather of day {i} was fair and the harbour quiet\nwith some {i * 7} boats at anchor\n\nnothing else happened on day {i}" for i in range(60)]
    wrapped = ["\n".join(textwrap.wrap(t, w)) for _, t in license_scan.TEMPLATES for w in (9, 30, 76)]
    texts = [*prose, *[f"{p}\n \n{w}\n\nend" for p, w in zip(prose, wrapped, strict=False)], *wrapped, *wrapped[:5], None, "", "\n\n", "---\n---"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = license_scan.LicenseModel(spark, license_scan.paragraphs(docs), 200)
    kept = model.possible(docs)
    found = lambda rows, **flags: sorted(map(tuple, model.scan(license_scan.paragraphs(rows, **flags)).collect()), key=repr)
    assert found(kept, flagged=True) == found(docs) != []
    assert kept.filter("not in_lines or not in_runs").count() > 0
    assert kept.filter("doc_id < 60").count() < 20


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, given, SF_DIR).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.columns == given.columns and 0 < kept.count() <= given.count()
        given = kept
    assert corpus_pipeline.pack(spark, given, SF_DIR).select("doc_id").distinct().count() == given.count()
