"""Prefix trie, source mixing and tokenizer links against brute force: nulls, empties, ties, repeats, several merges."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import oracle
from conftest import SF_DIR
from flowtide.llm import mixing, prefix_trie, token_links
from flowtide.llm.queries import OP11_SQL, OP12_SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string, keys string, family int"


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)


def trie_by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            whole = f"{len(role or '')}:{role or ''}{text or ''}"
            own[conv].append(((turn is not None, turn or 0, hashlib.sha256(whole.encode()).hexdigest()), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        full[c] = own.get(base, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = set()
    for path, convs in members.items():
        under = [p for p in members if p[:len(path)] == path]
        leaf = [p for p in under if not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in members)]
        saved = sum((len(members[p]) - 1) * len(WORD.findall(p[-1][1])) for p in under if p)
        ends = ",".join(map(str, sorted(c for c in convs if len(full[c]) == len(path))))
        out.add((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs),
                 sum(len(p) == len(path) + 1 for p in under), len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_rows(frame):
    return [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in frame.collect()]


def some_turns():
    rng = np.random.default_rng(3)
    rows = []
    for c in range(-7, 150):
        rows += [(c, t, str(rng.integers(2)), "w " * int(rng.integers(1, 3))) for t in range(int(rng.integers(1, 7)))]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 300) for t in range(5)]   # copies
    rows += [(400, t, "u", "deep") for t in range(300)] + [(401, t, "u", "deep") for t in range(299)]
    rows += [(None, 1, "a", "b"), (500, None, None, None), (500, 1, None, ""), (500, 1, "", None), (500, 1, "b", "tie"), (500, 1, "a", "tie"), (501, None, "a", "x"), (501, -3, "a", "y")]
    return rows


@pytest.mark.parametrize(("tasks", "merge", "block"), [(None, 64, 1 << 20), (13, 2, 9)])
def test_trie_matches_brute_force(spark, tasks, merge, block):
    rows = some_turns()
    got = trie_rows(prefix_trie.trie(prefix_trie.rebuilt(turns_frame(spark, rows)), tasks, merge, block))
    want = trie_by_hand(rows)
    assert len(got) == len(want) and set(got) == want


def test_trie_of_nothing_and_of_one(spark):
    assert trie_rows(prefix_trie.trie(prefix_trie.rebuilt(turns_frame(spark, [(None, 1, "a", "b")])))) == []
    rows = [(3, 0, "a", "b c")]
    assert set(trie_rows(prefix_trie.trie(prefix_trie.rebuilt(turns_frame(spark, rows))))) == trie_by_hand(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=5), min_size=1, max_size=30))
def test_forest_of_paths(lists):
    """Union-find over sorted neighbours finds every node that branches or ends, and its parent."""
    paths = sorted({b"".join(bytes([x]) * prefix_trie.KEY for x in one) for one in lists})
    shared = [0, *(prefix_trie.common(a, b) for a, b in zip(paths, paths[1:]))]
    zero = [0] * len(paths)
    depths = [len(p) // prefix_trie.KEY for p in paths]
    forest = prefix_trie.Forest(paths, depths, shared, [1] * len(paths), list(range(len(paths))), zero, zero, zero)
    names = [paths[forest.rep[n]][:forest.depth[n] * prefix_trie.KEY] for n in range(len(forest.depth))]
    prefixes = {p[:k] for p in paths for k in range(0, len(p) + 1, prefix_trie.KEY)}
    nexts = Counter(p[:-prefix_trie.KEY] for p in prefixes if p)
    assert sorted(names) == sorted({p for p in prefixes if nexts[p] > 1} | set(paths) | {b""})
    for n, name in enumerate(names):
        above = [m for m in names if len(m) < len(name) and name.startswith(m)]
        assert (names[forest.parent[n]] if forest.parent[n] >= 0 else None) == (max(above, key=len) if above else None)


DOCS = "doc_id long, text string, source string, key string, size int"


def docs_frame(spark, rows):
    return spark.createDataFrame([(*r, "k", -1) for r in rows], DOCS)


def mix_rows():
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(1, 60)), f"s{i % 4}") for i in range(400)]
    rows += [(1000 + i, "word " * 300, "hot") for i in range(600)]
    rows += [(2000, "x " * 30000, "s1"), (2001, None, "s2"), (2002, "", "empty"), (2003, None, None), (2004, "a\tb\x0bc", None), (None, "n n n", "é"), (2005, "z", "\U0001F600")]
    rows += [(3000, "twin " * 7, "twins")] * 200
    return rows


def test_mix_meets_targets_and_agrees(spark):
    rows = mix_rows()
    frame = docs_frame(spark, rows)
    got = [tuple(r) for r in mixing.mix(frame, carry=["doc_id", "source", "text"]).select("doc_id", "text", "source", "size", "source_size", "target", "copies").collect()]
    assert Counter(r[:3] for r in got) == Counter(rows)
    assert all(size == len(WORD.findall(text or "")) and 0 <= copies <= 3 for _, text, _, size, _, _, copies in got)
    sources = sorted({r[2] for r in rows if r[2] is not None}, key=lambda s: s.encode()) + [None]
    sizes = {s: sum(r[3] for r in got if r[2] == s) for s in sources}
    want, total, full = {}, sum(sizes.values()), set()
    while True:   # share, cut off, share again
        free = [s for s in sources if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        rate = left / sum(1 + sources.index(s) % 3 for s in free)
        want = {s: 3 * sizes[s] if s in full else rate * (1 + sources.index(s) % 3) for s in sources}
        more = {s for s in free if want[s] > 3 * sizes[s]}
        if not more:
            break
        full |= more
    for s in sources:
        mine = [r for r in got if r[2] == s]
        assert {r[4] for r in mine} == {sizes[s]} and np.allclose([r[5] for r in mine], want[s])
        taken = sum(r[3] * r[6] for r in mine)
        assert abs(taken - want[s]) <= max([1, *(r[3] for r in mine if r[6] == 0)]) / 2 or abs(taken - want[s]) <= 10, (s, taken, want[s])
    again = mixing.mix(frame.repartition(5), carry=["doc_id", "source", "text"]).select("doc_id", "text", "source", "size", "source_size", "target", "copies").collect()
    assert Counter(map(tuple, again)) == Counter(got)


def test_mix_by_shuffle_joins_and_whole_rows(spark, monkeypatch):
    rows = mix_rows()[:300]
    frame = docs_frame(spark, rows)
    path = "mixed-docs"
    plain = Counter(map(tuple, mixing.mix(frame, carry=["doc_id"]).select("doc_id", "copies").collect()))
    spark_lookup = mixing.lookup
    monkeypatch.setattr(mixing, "lookup", lambda big, dim, key: spark_lookup(big, dim, key, max_rows=0, hot_rows=20))
    assert Counter(map(tuple, mixing.mix(frame, carry=["doc_id"]).select("doc_id", "copies").collect())) == plain
    monkeypatch.undo()
    stored = mixing.stored(frame, path)
    out = mixing.mixed(stored)
    assert out.columns == frame.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({d: n for (d, n), _ in plain.items() if n})


def test_mix_of_nothing(spark):
    assert mixing.mix(docs_frame(spark, [])).count() == 0
    only = mixing.mix(docs_frame(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r.size, r.target, r.copies) for r in only] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize(("query", "sql"), [("op11_prefix_trie", OP11_SQL), ("op12_source_mixing", OP12_SQL)])
def test_sql_is_registered(query, sql):
    from flowtide.llm.queries import ENTRIES
    assert ENTRIES[query][1] == sql


def test_mixing_has_no_python_worker(spark):
    from flowtide.llm.queries import op12_source_mixing
    assert "Python" not in op12_source_mixing(spark, SF_DIR)._jdf.queryExecution().toString()


# --- links -----------------------------------------------------------------------------------------------------

vocabularies = pytest.importorskip("public_tokenizers")
FILES = (vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN, vocabularies.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    return a, {i: t for t, i in a.get_vocab().items()}, letters, sentencepiece.SentencePieceProcessor(model_file=FILES[2])


def links_by_hand(sides, text):
    """(A ids, B ids, links as id pairs, groups), or None."""
    a, names, letters, b = sides
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    spelt_a = [bytes(letters[c] for c in names[i]) for i in ids_a]
    spelt_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(spelt_a) == b"".join(spelt_b) == (" " + text).encode():
        return None

    def spans(parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *ends[:-1]], ends))
    sa, sb = spans(spelt_a), spans(spelt_b)
    pairs = [(x, y) for x, (s, e) in enumerate(sa) for y, (t, f) in enumerate(sb) if s < f and t < e]
    cuts = sorted({e for _, e in sa} & {e for _, e in sb})
    groups, low = [], 0
    for cut in cuts:
        groups.append(([ids_a[i] for i, (_, e) in enumerate(sa) if low < e <= cut], [ids_b[i] for i, (_, e) in enumerate(sb) if low < e <= cut]))
        low = cut
    return ids_a, ids_b, [(ids_a[x], ids_b[y]) for x, y in pairs], groups


TEXTS = ["plain words and more words", "a  b\n\n\t c ", " lead", "x", " ", "  ", "\n", "tab\tend ", "don't we'll 3.14 €5 naïve ouèelleê", "日本語 テキスト です", "<|endoftext|> </s> <unk>",
         "▁mark", "é \U0001F600 ​ z\x1c y\xa0 w　 v", "q" * 300 + " " + "ab" * 200, "one\r\ntwo  three   four", "emoji👩‍👩‍👧x", "trail  ", "a\n b\n  c"]


def test_alignment_matches_brute_force(spark, sides):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(100, None, "x", 2), (101, "", "x", 2), (None, "null id", "x", 3), (0, TEXTS[0], "x", 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, codes string, rid int")
    hand = [links_by_hand(sides, r[1]) for r in rows]
    held = Counter(pair for h in hand if h for pair in h[2])
    most = defaultdict(int)
    for (_, b), n in held.items():
        most[b] = max(most[b], n)
    want = Counter()
    for (doc_id, *_), h in zip(rows, hand):
        if h is None:
            want[(doc_id, 0, 0, 0, 0, 0, 0, "", 0)] += 1
        else:
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in h[3])
            want[(doc_id, len(h[0]), len(h[1]), len(h[3]), len(h[2]), sum(held[p] == most[p[1]] for p in h[2]), sum(held[p] for p in h[2]),
                  hashlib.sha256(text.encode()).hexdigest(), sum(len(x) * len(y) for x, y in h[3]))] += 1
    for limit in (10**6, 20):   # one block of id pairs, and many
        assert Counter(map(tuple, token_links.align(frame, *FILES, limit=limit).collect())) == want
    assert hand[TEXTS.index("<|endoftext|> </s> <unk>")] is not None and hand[TEXTS.index("▁mark")] is None
    found = Counter((r.doc_id, r.a_id, r.b_id) for r in token_links.links(frame, *FILES).collect())
    assert found == Counter((doc_id, *pair) for (doc_id, *_), h in zip(rows, hand) if h for pair in h[2])
    shared = Counter((r.doc_id, r.a_id, r.b_id) for r in token_links.links(frame, *FILES, shared_groups=True).collect())
    assert shared == Counter((doc_id, x, y) for (doc_id, *_), h in zip(rows, hand) if h for g in h[3] for x in g[0] for y in g[1])


def test_alignment_of_nothing(spark):
    assert token_links.align(spark.createDataFrame([], "doc_id long, text string"), *FILES).count() == 0


@pytest.fixture(scope="module")
def pair():
    with open(FILES[0], "rb") as ranks, open(FILES[2], "rb") as model:
        return token_links.Pair(ranks.read(), FILES[1], model.read())


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("ab'.3 \n\t\x1c\x85\xa0 é日👩")), min_size=1, max_size=25))
def test_chunks_encode_alone(pair, text):
    chunks = pair.chunks(text)
    assert "".join(chunks) == " " + text
    assert [i for c in chunks for i in pair.a.encode_ordinary(c)] == pair.a.encode_ordinary(" " + text)
    assert [i for ids in pair.encode_b(chunks) for i in ids] == pair.b.encode(text)


def test_store_of_blocks_starts_again(pair, monkeypatch):
    monkeypatch.setattr(token_links, "BLOCKS", 1)
    blocks = token_links.Blocks(pair)
    blocks.learn([" a", " bc", " d▁"])
    assert blocks.full() and len(blocks.known) == 3
    assert blocks.row(np.array([0, 1, 0]))[:4] == (3, 3, 3, 3) and blocks.row(np.array([0, 2]))[:4] == (0, 0, 0, 0)


def test_entries_match_their_sql_at_another_size(spark):
    from flowtide.llm.queries import op11_prefix_trie
    assert oracle.compare(spark, oracle.connect("/root/testdata/sf0.01"), op11_prefix_trie, OP11_SQL, "/root/testdata/sf0.01") is None
