"""Every operator against brute force, on the small tables and on rows with nulls,
empty and long texts, ties, repeats, and extra columns with clashing names."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from simplicia.llm import chat, hmm_lm, mixing, near_dedup, quality, queries, sentence_pieces, token_counts, topk, toxicity, url_filter
from simplicia.llm.kernel import words_of
from simplicia.llm.shared import read

WORD = re.compile("[^\x20\x09-\x0d]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}x" for i in range(30_000))
NASTY = [
    (1, None, "en", "web"),
    (2, "", "en", "web"),
    (3, " \t\n", None, None),
    (4, "one two three", "en", "web"),
    (5, "One TWO three", "xx", "forum"),
    (6, "a b c d e f g h i j k l", "en", "web"),
    (6, "a b c d e f g h i j k l", "en", "web"),
    (7, "a b c d e f g h i j k l", "de", None),
    (8, LONG, "en", "books"),
    (9, LONG + " end", "en", "books"),
    (10, "É\u00a0x  <|endoftext|> ▁▁ \x00 é 🤖\n\n\n x", "en", "web"),
    (11, "same line here\nsame line here\n\nsame line here", "en", "web"),
    (12, "x" * 5000, "en", "web"),
    (None, "a b c d e f g h i j k l m", "en", "web"),
]


@pytest.fixture(scope="module")
def nasty(spark):
    """The rows above, with extra columns named like ones inside the operators."""
    docs = spark.createDataFrame(NASTY, "doc_id long, text string, lang string, source string")
    clash = {c: F.lit(f"own {c}") for c in ("n", "key", "size", "rep", "__gone", "__toxicity", "__Q_n_words", "__mix_size", "ids", "score", "a.b")}
    return docs.withColumns(clash)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def same(df, expected, *columns):
    found = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert found == sorted(expected, key=repr)


def empty(df):
    return df.where("false")


# 1. chat formatting


def test_chat_round_trip_of_control_strings():
    for text in ("<|im_end|>", "<\\|im_end|>", "<\\\\|x", "a<|im_end|>\n<|im_start|>user\n", "", "<|im_end|", "<|", "\\<|endoftext|>", "<\\|im_start|><|im_end|>"):
        turns = [("user", text), ("assistant\n<|im_end|>\\n", text)]
        rendered, _ = chat.format_turns(turns)
        assert [t[:2] for t in chat.parse(rendered)] == turns
    assert chat.format_turns([("user", "plain <\\ text")])[1] == 0
    assert chat.parse("no turns") is None and chat.parse("") == []


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "q"), (1, 2, "assistant", "é<|im_end|>"), (2, 0, "user", "x"), (2, 0, "user", "x"), (None, 0, "user", "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    found = {r["conv_id"]: r for r in chat.read_conversations(chat.format_conversations(table)).collect()}
    assert [(t["role"], t["text"]) for t in found[1]["turns"]] == [("", "q"), ("assistant", ""), ("assistant", "é<|im_end|>")]
    assert found[1]["loss_text"] == "é<|im_end|>"
    assert len(found[2]["turns"]) == 2 and set(found) == {1, 2, None}
    assert chat.format_conversations(empty(table)).count() == 0


def test_chat_of_long_texts(spark):
    """Megabytes of text, control strings among them, come back whole; columns with clashing names don't matter."""
    long = "<|im_end|>\n<|im_start|>user é " * 40_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "assistant", "x" * 2_000_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"loss_text": F.lit(0), "n_turns": F.lit("own"), "a.b": F.lit(1)})
    found = {r["conv_id"]: r for r in chat.read_conversations(chat.format_conversations(table)).collect()}
    assert [t["text"] for t in found[1]["turns"]] == [long, long] and found[1]["loss_text"] == long
    assert found[2]["loss_text"] == rows[2][3]


# 2. URL filters


def test_url_filter_edges(spark):
    urls = [(1, None), (2, "nothing"), (3, "HTTP://Sub.Example.COM?x=/en/7"), (4, "x://example.com/en/77#f"), (5, "x://notexample.com/en/7"), (6, "x://a.com/en/8"), (6, "x://a.com/en/8"), (7, "://"), (8, "x://example.com/en")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumns({"key": F.lit(1), "host": F.lit("mine")})
    listed = spark.createDataFrame([("http://A.com/en/8?q",), (None,), ("https://example.com/en",)], "url string")
    found = url_filter.filter_urls(pages, url_filter.POLICY, listed)
    same(
        found,
        [
            (1, "", "", None, "allow"),
            (2, "", "", None, "allow"),
            (3, "sub.example.com", "", None, "allow"),
            (4, "example.com", "/en/77", "example.com/en/7", "allow"),
            (5, "notexample.com", "/en/7", "com/en/", "block"),
            (6, "a.com", "/en/8", "com/en/", "block"),
            (6, "a.com", "/en/8", "com/en/", "block"),
            (7, "", "", None, "allow"),
            (8, "example.com", "/en", None, "block"),
        ],
        "page_id", "host", "path", "rule", "verdict",
    )
    assert url_filter.filter_urls(empty(pages), url_filter.POLICY, listed).count() == 0
    assert url_filter.filter_urls(pages, [], empty(listed)).where("verdict = 'block'").count() == 0


def test_url_filter_of_long_urls_and_repeats(spark):
    far = "http://Long.Example.net/" + "p" * 200_000
    pages = spark.createDataFrame([(1, far + "?q=" + "x" * 100_000), (2, far), (2, far), (3, far + "p"), (None, far)], "page_id long, url string").withColumns({"rule": F.lit("own"), "a.b": F.lit(2)})
    listed = spark.createDataFrame([("x://LONG.example.NET/" + "p" * 200_000 + "#f",), (far,)], "url string").withColumn("key", F.lit(0))
    host, path = "long.example.net", "/" + "p" * 200_000
    same(url_filter.filter_urls(pages, (), listed), [(1, host, path, None, "block"), (2, host, path, None, "block"), (2, host, path, None, "block"), (3, host, path + "p", None, "allow"), (None, host, path, None, "block")], "page_id", "host", "path", "rule", "verdict")


def test_listed_and_unlisted_pages_share_hosts(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    found = url_filter.filter_urls(pages, (), url_filter.listed_pages(pages)).collect()
    blocked, allowed = ({r["host"] for r in found if r["verdict"] == v} for v in ("block", "allow"))
    assert blocked & allowed and 0.1 < sum(r["verdict"] == "block" for r in found) / len(found) < 0.5


@pytest.mark.parametrize("most", [1 << 19, 1])
def test_filter_beyond_what_is_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", most)
    keys = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    both = spark.range(6000).select(F.col("id").cast("string").alias("key"))
    found = {r["key"] for r in url_filter.possible_hits(both, keys).collect()}
    assert found >= set(map(str, range(3000))) and len(found) < 3300


def test_bloom_filter_passes_every_listed_key(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    assert url_filter.possible_hits(keys, keys).count() == 20_000
    others = spark.range(20_000, 40_000).select(F.col("id").cast("string").alias("key"))
    assert url_filter.possible_hits(others, keys).count() < 2_000


# 3. token counts


def test_token_counts_are_the_library_s(docs, nasty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for table in (docs, nasty):
        expected = [(i, len(t.encode()), n := len(tokenizer.encode(t, add_special_tokens=False)), n > 512) for i, t in texts_of(table)]
        same(token_counts.count_tokens(table), expected, "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert token_counts.count_tokens(empty(nasty)).count() == 0


# 4. near-duplicates


def brute_sets(rows):
    out = []
    for i, text in rows:
        words = WORD.findall(text.translate(UPPER))
        out.append((i, {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}))
    return out


def brute_components(rows):
    sets = brute_sets(rows)
    group = list(range(len(sets)))
    holders: dict = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)

    def root(k):
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    first: dict = {}
    for k, (i, s) in enumerate(sets):
        if i is None:
            continue
        if s:  # all texts of a document
            group[root(k)] = root(first.setdefault(i, k))
        for j, both in Counter(j for x in s for j in holders[x] if j < k).items():
            if sets[j][0] is not None and 100 * both >= 75 * (len(s) + len(sets[j][1]) - both):
                group[root(k)] = root(j)
    least: dict = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, len(s), None if i is None else least[root(k)], i is None or i == least[root(k)]) for k, (i, s) in enumerate(sets)]


def test_near_duplicates_are_brute_force_s(docs, nasty):
    for table in (docs, nasty):
        same(near_dedup.near_duplicates(table), brute_components(texts_of(table)), "doc_id", "n_shingles", "component_id", "kept")
    assert near_dedup.near_duplicates(empty(nasty)).count() == 0


def test_links_between_copies_with_changes(spark):
    rng = np.random.default_rng(3)
    rows, base = [], [f"t{k}" for k in range(60)]
    for i in range(150):
        words = list(base)
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(0, 60)] = f"n{i}x{rng.integers(0, 5)}"
        rows.append((i, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    same(near_dedup.near_duplicates(table), brute_components(rows), "doc_id", "n_shingles", "component_id", "kept")


def test_documents_of_several_texts(spark):
    """A doc_id that repeats with other texts is linked with what each of them is."""
    text = lambda k, n=12: " ".join(f"t{k}w{i}" for i in range(n))
    rows = [(5, text(1)), (5, text(2)), (3, text(2, 13)), (7, text(1, 13)), (9, text(3)), (9, text(3)), (8, text(4)), (8, ""), (6, text(4, 13)), (2, text(9)), (2, text(8)), (2, text(9, 13))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_components(rows)
    assert {(5, 3), (7, 3)} <= {(i, c) for i, _, c, _ in expected}
    same(near_dedup.near_duplicates(table).where("n_shingles > 0"), [r for r in expected if r[1]], "doc_id", "n_shingles", "component_id", "kept")


def test_keep_one_keeps_columns(nasty):
    kept = near_dedup.keep_one(nasty)
    assert kept.columns == nasty.columns
    ids = sorted(r["doc_id"] or -1 for r in kept.collect())
    assert ids == [-1, 1, 2, 3, 4, 6, 6, 8, 10, 11, 12]


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    assert {r["component"] for r in near_dedup.components(edges).collect()} == {0}


def test_sketch_fills_every_coordinate_and_estimates_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(1, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], rng.integers(1, 2**63, 100, dtype=np.uint64)])
    s = near_dedup.sketch([np.sort(a), np.sort(b), a[:1], a[:0]], 1024, 1)
    assert (s[:3] > 0).all() or (s[:3] == 0).sum() <= 1
    assert not s[3].any()
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.06


# 5. SentencePiece


def test_pieces_are_the_library_s(docs, nasty):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(0)
    rows = [t for _, t in texts_of(docs) + texts_of(nasty)] + ["".join(rng.choice(list("  ▁aetinosr\nÀ中🤖.,<>"), 120)) for _ in range(200)] + [" " * 100 + "a", "ab" * 3000]
    encoder = sentence_pieces.Encoder(p := sentence_pieces.load_pieces())
    decoder = sentence_pieces.Decoder(p)
    found, back = [], []
    for ids, at in encoder.encode(pa.array(rows)):
        found += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
        back += decoder.decode(ids, at)
    assert found == sp.encode(rows, num_threads=1)
    assert back == [t.replace("▁", " ") for t in rows]
    assert back == [sp.decode(x) for x in found]


def test_round_trip_rows(nasty):
    found = sentence_pieces.encode_and_decode(nasty).collect()
    assert len(found) == len(NASTY)
    assert all(r["round_trip"] == (r["doc_id"] != 10) and r["n_pieces"] == len(r["ids"]) for r in found)
    assert {r["n_pieces"] for r in found if r["doc_id"] in (1, 2)} == {0}
    assert sentence_pieces.encode_and_decode(empty(nasty)).count() == 0


def _message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3, value])
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + np.float32(value).tobytes()
        else:
            size, raw = len(value), b""
            while size > 127:
                raw += bytes([size & 127 | 128])
                size >>= 7
            out += bytes([number << 3 | 2]) + raw + bytes([size]) + value
    return out


def test_unigram_paths_are_the_library_s(tmp_path):
    """A small unigram model with byte fallback, written by hand."""
    names = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "aa", "bca", "▁▁"]
    pieces = [_message((1, b"<unk>"), (2, 0.0), (3, 2)), _message((1, b"<s>"), (2, 0.0), (3, 3)), _message((1, b"</s>"), (2, 0.0), (3, 3))]
    pieces += [_message((1, f"<0x{b:02X}>".encode()), (2, 0.0), (3, 6)) for b in range(256)]
    pieces += [_message((1, s.encode()), (2, -1.0 - (k * 7 % 13) * 0.37 - 0.1 * k)) for k, s in enumerate(names)]
    model = b"".join(_message((1, p)) for p in pieces) + _message((2, b"\x18\x01\x98\x02\x01")) + _message((3, _message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    path = tmp_path / "tiny.model"
    path.write_bytes(model)
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    rng = np.random.default_rng(1)
    rows = ["".join(rng.choice(list("aaabbbccc é"), rng.integers(0, 40))) for _ in range(300)]
    encoder = sentence_pieces.Encoder(sentence_pieces.load_pieces(str(path)))
    found = [ids[a:b].tolist() for ids, at in encoder.encode(pa.array(rows)) for a, b in zip(at[:-1], at[1:])]
    assert found == sp.encode(rows, num_threads=1)


# 6. top-k


def brute_top_k(asked, rows, k, scale=1.0):
    """Every score as an integer of any size, by query row."""
    weight = lambda v: [topk.exact_weight(float(x), scale) for x in v]
    rows = [(i, weight(v)) for i, v in rows]
    out = []
    for q, v in asked:
        x = weight(v)
        best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q)[:k]
        out += [(q, rank, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for rank, (s, i) in enumerate(best, 1)]
    return out


def test_top_k_against_all_scores(spark):
    rng = np.random.default_rng(2)
    rows = [*enumerate(rng.integers(-3, 4, (400, 6)).tolist()), (1001, [])]
    table = spark.createDataFrame([*rows, (1000, None), (None, [1] * 6)], "vec_id long, v array<long>").withColumn("score", F.lit(9))
    asked = table.where("vec_id % 7 = 0")
    for k in (5, 1000):
        same(topk.top_k(asked, table, k, 1.0), brute_top_k([r for r in rows if r[0] % 7 == 0], rows, k), "query_id", "rank", "vec_id", "score")
    assert topk.top_k(empty(table), table).count() == 0 and topk.top_k(table, empty(table)).count() == 0


def test_top_k_over_many_cells(spark, monkeypatch):
    """Rounds of shards and blocks, copies and ties among them."""
    monkeypatch.setattr(topk, "LEAST_ROWS", 16)
    monkeypatch.setattr(topk, "CELL_BYTES", 8 * 5 * 20)
    rng = np.random.default_rng(4)
    rows = list(enumerate(rng.normal(0, 1, (600, 5)).astype(np.float32).tolist()))
    rows += [(k, rows[7][1]) for k in range(600, 700)]
    table = spark.createDataFrame(rows, "vec_id long, v array<float>")
    same(topk.top_k(table.where("vec_id % 10 = 0"), table, 6), brute_top_k([r for r in rows if r[0] % 10 == 0], rows, 6, 64.0), "query_id", "rank", "vec_id", "score")


@pytest.mark.parametrize("size", [2.0**28, 2.0**60, 1e200, 1.5e308])
def test_top_k_of_large_components(spark, size):
    """Sums beyond 53 and 64 bits, ties by one, opposite signs, and small vectors beside large ones."""
    rng = np.random.default_rng(9)
    vectors = (rng.uniform(-1, 1, (40, 5)) * size).tolist() + rng.integers(-9, 9, (20, 5)).astype(float).tolist()
    vectors += [[size, 1.0, 0, 0, 0], [size, 2.0, 0, 0, 0], [1e15, 1.0], [-size, 0, 0, 0, 0], vectors[0]]
    rows = list(enumerate(vectors))
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, v array<double>")
    same(topk.top_k(table, table, 7), brute_top_k(rows, rows, 7, 64.0), "query_id", "rank", "vec_id", "score")


def test_top_k_of_repeated_ids(spark):
    """A repeated id has a list for each of its rows, in which none of its rows stand."""
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 5.0])]
    table = spark.createDataFrame(rows, "vec_id long, v array<double>")
    same(topk.top_k(table.where("vec_id = 20"), table, 3), brute_top_k([r for r in rows if r[0] == 20], rows, 3, 64.0), "query_id", "rank", "vec_id", "score")


def test_top_k_leaves_out_what_isn_t_finite(spark):
    rows = [(1, [0.5, -0.51]), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, None), (5, [float("inf")]), (6, []), (7, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, v array<float>")
    same(topk.top_k(table, table), [(1, 1, 7, 32 * 64), (1, 2, 6, 0), (6, 1, 1, 0), (6, 2, 7, 0), (7, 1, 1, 32 * 64), (7, 2, 6, 0)], "query_id", "rank", "vec_id", "score")


# 7. quality rules


def brute_quality(text):
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts = Counter(windows)
    repeated = {k + d for k, w in enumerate(windows) if counts[w] > 1 for d in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated)


def test_quality_counts_are_brute_force_s(docs, nasty):
    for table in (docs, nasty):
        expected = []
        for i, text in texts_of(table):
            n = brute_quality(text)
            expected.append((i, *n, n[0] < 10 or 100 * n[4] > 20 * n[0]))
        found = quality.judge_quality(table)
        same(found, expected, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert found.where("base_failed AND kept").count() == 0
    assert quality.judge_quality(empty(nasty)).count() == 0
    assert quality.keep_good(nasty).columns == nasty.columns


def brute_kept(rows, rules=quality.QualityRules()):
    """Verdicts from histograms of Python counters; rows are (doc_id, text, lang)."""

    def kind(c):
        if c in "abcdefghijklmnopqrstuvwxyz":
            return 0
        if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
            return 1
        if c in "0123456789":
            return 2
        if c in " \t":
            return 3
        if c in "\n\x0b\x0c\r":
            return 4
        if c in ".,;:!?'\"-()":
            return 5
        return 6 if ord(c) < 128 else 7

    def distance(p, q):
        a, b = sum(p.values()), sum(q.values())
        if not a:
            return 0.0
        total = 0.0
        for k in p.keys() | q.keys():
            x, y = p[k] / a, q[k] / max(b, 1)
            m = (x + y) / 2
            total += (x * math.log2(x / m) if x else 0) + (y * math.log2(y / m) if y else 0)
        return math.sqrt(max(total / 2, 0))

    chars: dict = {}
    words: dict = {}
    for _, text, lang in rows:
        chars.setdefault(lang, Counter()).update(map(kind, text or ""))
        words.setdefault(lang, Counter()).update(WORD.findall(text or ""))
    out = []
    for i, text, lang in rows:
        n = brute_quality(text or "")
        total = sum(words[lang].values())
        common = {w for w, c in words[lang].items() if c >= rules.common_share * total}
        folded = lambda c: Counter({w: k for w, k in c.items() if w in common}) + Counter({None: sum(k for w, k in c.items() if w not in common)})  # noqa: E731, B023
        far = distance(Counter(map(kind, text or "")), chars[lang]) > rules.max_char_distance
        far |= distance(folded(Counter(WORD.findall(text or ""))), folded(words[lang])) > rules.max_word_distance + rules.word_slack / math.sqrt(max(n[0], 1))
        out.append((i, not (n[0] < 10 or 100 * n[4] > 20 * n[0] or (n[0] >= rules.guard_words and far))))
    return out


@pytest.mark.parametrize("most", [500, 2])
def test_quality_verdicts_are_brute_force_s(spark, docs, nasty, most):
    """On the table, with languages that are null, empty and rare, and on the nasty rows."""
    lang = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 1, "").when(F.col("doc_id") % 7 == 2, "null").otherwise(F.col("lang"))
    for table in (docs, docs.withColumn("lang", lang), nasty):
        expected = brute_kept([(r["doc_id"], r["text"], r["lang"]) for r in table.select("doc_id", "text", "lang").collect()])
        same(quality.judge_quality(table, quality.QualityRules(max_languages=most)), expected, "doc_id", "kept")


def test_js_distance():
    p, q = np.array([[1.0, 0.0], [5.0, 5.0], [0.0, 0.0]]), np.array([5.0, 5.0])
    m = np.array([0.75, 0.25])
    expected = math.sqrt((math.log2(1 / m[0]) + 0.5 * math.log2(0.5 / m[0]) + 0.5 * math.log2(0.5 / m[1])) / 2)
    assert np.allclose(quality.js_distance(p, q), [expected, 0.0, 0.0])


def test_quality_rejects_divergent_texts(spark):
    rng = np.random.default_rng(4)
    common = ["the", "of", "and", "to", "in", "cat", "dog", "runs", "over", "hill"]
    rows = [(i, " ".join(f"{w}{rng.integers(0, 40)}" if rng.random() < 0.4 else w for w in rng.choice(common, 200)), "en") for i in range(100)]
    rows += [(1000, "".join(rng.choice(list("0123456789#$% "), 1500)), "en")]
    verdicts = {r["doc_id"]: r["kept"] for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not verdicts[1000]
    assert sum(verdicts.values()) == 100


def test_quality_judges_languages_beyond_the_largest(spark):
    words = {k: [f"{k}{n}word" for n in range(30)] for k in ("aa", "bb", "cc")}
    rng = np.random.default_rng(3)
    rows = [(f"{k}{i}", " ".join(rng.choice(words[k], 80)), k) for k, m in (("aa", 60), ("bb", 30), ("cc", 20)) for i in range(m)]
    rows += [(f"junk {k}", " ".join(f"#{n}$%9{k}" for n in range(200)), k) for k in words]
    rows += [("null", " ".join(rng.choice(words["aa"], 80)), None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string").withColumn("a.b", F.lit(1))
    full = {r["doc_id"]: r for r in quality.judge_quality(docs).collect()}
    few = quality.QualityRules(max_languages=1)
    found = quality.judge_quality(docs, few).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["kept"] == full[r["doc_id"]]["kept"] == (not r["doc_id"].startswith("junk"))
        assert np.allclose([r["char_distance"], r["word_distance"]], [full[r["doc_id"]]["char_distance"], full[r["doc_id"]]["word_distance"]])
    kept = quality.keep_good(docs, few)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3


# 8. language-model scores


def tokens_of(text):
    return [*WORD.findall(text.translate(UPPER)), None]


def held_out(i, folds):
    return zlib.crc32(("" if i is None else str(i)).encode()) % folds == 0


def test_base_scores_are_brute_force_s(docs, nasty):
    for table in (docs, nasty):
        rows = texts_of(table)
        counts = Counter(t for i, text in rows if not held_out(i, 10) for t in tokens_of(text))
        n, v = sum(counts.values()), len(counts)
        expected = {}
        for i, text in rows:
            t = tokens_of(text)
            base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
            expected.setdefault((i, len(t), sum(x in counts for x in t)), []).append(base)
        found = hmm_lm.score_texts(table).collect()
        assert len(found) == len(rows)
        for r in found:
            assert r["held_out"] == held_out(r["doc_id"], 10) and r["train_tokens"] == n
            assert any(math.isclose(r["base_score"], x, rel_tol=1e-9) for x in expected[r["doc_id"], r["n_tokens"], r["n_known"]])
            assert math.isfinite(r["score"]) and r["score"] < 0
    assert hmm_lm.score_texts(empty(nasty)).count() == 0


def test_open_tokens_join_like_held_ones(docs):
    rules = hmm_lm.HmmRules(own=64, buckets=64, steps=2)
    few = hmm_lm.HmmRules(own=64, buckets=64, steps=2, held=64)
    a = {r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in hmm_lm.score_texts(docs, rules).collect()}
    b = {r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in hmm_lm.score_texts(docs, few).collect()}
    for i in a:
        assert a[i][0] == b[i][0] and np.allclose(a[i][1:], b[i][1:], rtol=1e-6)


def test_forward_and_expected_counts_are_those_of_all_paths():
    """Against sums over all state sequences of short texts."""
    rng = np.random.default_rng(6)
    s, k = 3, 4
    start, move, emit = rng.random(s), rng.random((s, s)), rng.random((k, s))
    m = hmm_lm.Model(0, 0, np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.zeros(1), np.zeros(1), start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0), hmm_lm.HmmRules(states=s))
    texts = [[0, 1, 2, 3], [2], [3, 3, 1]]
    packed = hmm_lm.Packed(np.concatenate([np.array(t) for t in texts]), np.array([len(t) for t in texts]))
    likelihood, expected = [], np.zeros((s, s))
    for t in texts:
        paths = []
        for path in itertools.product(range(s), repeat=len(t)):
            p = m.start[path[0]] * m.emit[t[0], path[0]]
            for a, b, x in zip(path, path[1:], t[1:]):
                p *= m.move[a, b] * m.emit[x, b]
            paths.append((p, path))
        total = sum(p for p, _ in paths)
        likelihood.append(math.log(total))
        for p, path in paths:
            for a, b in zip(path, path[1:]):
                expected[a, b] += p / total
    assert np.allclose(packed.log_likelihood(packed.forward(m)[2]), likelihood)
    starts, moves, emits = packed.expected(m)
    assert np.allclose(moves, expected) and math.isclose(starts.sum(), 3) and math.isclose(emits.sum(), 8)


def test_every_step_goes_over_all_training_texts(spark):
    """Against the same steps in one process, on more texts than a sample would take."""
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(1, 6))) for _ in range(5000)]
    rules = hmm_lm.HmmRules(own=16, buckets=16, steps=3)
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    model, counts = hmm_lm.train(rows, rules)
    m = hmm_lm._initial(counts, rules)
    tokens, n = hmm_lm._batch_tokens(rows.toArrow().combine_chunks().to_batches()[0])
    packed, seen = hmm_lm.Packed(m.lookup(tokens)[0], n), []
    for _ in range(3):
        seen.append(packed.log_likelihood(packed.forward(m)[2]).sum())
        m = hmm_lm._normalised(m, *packed.expected(m))
    assert np.allclose(model.move, m.move) and np.allclose(model.emit, m.emit) and np.allclose(model.start, m.start)
    assert np.allclose(model.likelihoods, seen) and seen[0] < seen[1] < seen[2]


def test_steps_between_scaled_ones_keep_their_precision():
    """Against recursions in logarithms, on texts that end at and between scaled steps and hold very rare classes."""
    rng = np.random.default_rng(8)
    s, k = 4, 6
    start, move, emit = rng.random(s), rng.random((s, s)) ** 6, rng.random((k, s))
    emit[4:] *= 1e-20
    rules = hmm_lm.HmmRules(states=s)
    m = hmm_lm.Model(0, 0, np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.zeros(1), np.zeros(1), start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0), rules)
    lengths = np.array([1, 2, 4, 5, 6, 8, 9, 13, 700, 13])
    classes = rng.integers(0, k, lengths.sum())
    classes[-13:] = 5  # nothing but rare ones
    starts, moves, emits, likelihood = np.zeros(s), np.zeros((s, s)), np.zeros((k, s)), []
    with np.errstate(divide="ignore"):
        log_start, log_move, log_emit = np.log(m.start), np.log(m.move), np.log(m.emit)
    for i, n in zip(np.cumsum(lengths) - lengths, lengths):
        c = classes[i : i + n]
        a, b = [log_start + log_emit[c[0]]], [np.zeros(s)]
        for x in c[1:]:
            a.append(np.logaddexp.reduce(a[-1][:, None] + log_move, 0) + log_emit[x])
        for x in c[:0:-1]:
            b.insert(0, np.logaddexp.reduce(log_move + log_emit[x] + b[0], 1))
        total = np.logaddexp.reduce(a[-1])
        likelihood.append(total)
        for t in range(n):
            gamma = np.exp(a[t] + b[t] - total)
            emits[c[t]] += gamma
            starts += gamma if t == 0 else 0
            moves += np.exp(a[t - 1][:, None] + log_move + log_emit[c[t]] + b[t] - total) if t else 0
    packed = hmm_lm.Packed(classes, lengths)
    assert np.allclose(packed.log_likelihood(packed.forward(m)[2]), likelihood, rtol=1e-12)
    for found, expected in zip(packed.expected(m), (starts, moves, emits), strict=True):
        assert np.allclose(found, expected, rtol=1e-9)
    assert math.isclose(packed.likelihood, sum(likelihood), rel_tol=1e-12)


def test_texts_are_split_twice_whatever_the_number_of_steps(spark):
    """Once for the counts and once for the classes; splitting texts is most of the work."""
    read_rows = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            read_rows.add(batch.num_rows)
            yield batch

    rows = [(i, f"w{i % 7} w{i % 11} only{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(pass_on, "doc_id long, text string")
    found = hmm_lm.score_texts(docs, hmm_lm.HmmRules(own=16, buckets=16, steps=3, held=20)).collect()
    assert len(found) == 200 and read_rows.value <= 2 * 200


def test_states_beat_the_unigram_on_held_out_texts(spark):
    rows = read(spark, "/root/testdata/sf0.01", "documents")
    base, score = hmm_lm.score_texts(rows).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base


# 9. mixing


def test_mix_targets_and_limits(docs, nasty):
    for table in (docs, nasty):
        found = mixing.plan_mix(table).collect()
        source = {(r["doc_id"], r["text"]): r["source"] for r in table.select("doc_id", "text", "source").collect()}
        assert len(found) == table.count()
        assert all(r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0 for r in found)
        by_source = {}
        for (i, _), name in source.items():
            by_source.setdefault(i, name)
        taken, target, largest, size = Counter(), {}, Counter(), {}
        for r in found:
            name = by_source[r["doc_id"]]
            taken[name] += r["taken"]
            target[name], size[name] = r["target"], r["source_size"]
            largest[name] = max(largest[name], r["size"])
        assert all(abs(taken[s] - target[s]) <= largest[s] + 1e-6 for s in target)
        assert all(target[s] <= 3 * size[s] + 1e-6 for s in target)
        again = mixing.plan_mix(table.repartition(5)).collect()
        assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, again), key=repr)
    assert mixing.plan_mix(empty(nasty)).count() == 0


def test_mixed_documents_hold_what_the_plan_says(nasty):
    words = sum(len(WORD.findall(r["text"] or "")) for r in mixing.mix_documents(nasty).collect())
    assert words == mixing.plan_mix(nasty).agg(F.sum("taken")).first()[0]
    assert mixing.mix_documents(nasty).columns == nasty.columns


@pytest.mark.parametrize("together", [4096, 8])
def test_mix_cuts_among_equal_rows(spark, monkeypatch, together):
    """Equal rows share a key; as many of them are taken as fit, in the plan and in the mix."""
    monkeypatch.setattr(mixing, "TIED_ROWS", together)
    rows = [(None, "a b c", "x")] * 100 + [(None, "d e f", "y")] * 100 + [(5, "same row", None)] * 40 + [(k, "w " * (k % 7), None) for k in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7).withColumn("a.b", F.lit(1))
    found = mixing.plan_mix(table).collect()
    taken: Counter = Counter()
    target = {}
    for r in found:
        target[r["source_size"], r["target"]] = r["target"]
        taken[r["source_size"], r["target"]] += r["taken"]
    assert len(target) == 3 and all(abs(taken[k] - target[k]) <= 3 for k in target)
    duck = duckdb.connect()
    duck.register("documents", pa.table(dict(zip(("doc_id", "text", "source"), zip(*rows)))))
    columns = ("doc_id", "size", "source_size", "target", "taken")
    expected = duck.sql(f"SELECT {', '.join(columns)} FROM ({mixing.PLAN_MIX_SQL})").fetchall()
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in found) == Counter((*r[:3], round(r[3], 6), r[4]) for r in expected)
    mixed = mixing.mix_documents(table)
    assert mixed.columns == table.columns
    assert sum(len(WORD.findall(r["text"])) for r in mixed.collect()) == sum(taken.values())


# 10. toxicity


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = read(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = toxicity.score_toxicity(read(spark, sf, "documents"), read(spark, sf, "labels")).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    pos, neg = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    order = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    caught, alarms = sum(r["predicted"] for r in rows if r["toxic"]), sum(r["predicted"] for r in rows if not r["toxic"])
    print("accuracy", right, "area", order, "caught", caught, "of", len(pos), "alarms", alarms, "of", len(neg))
    # six of the toxic rows hold no mark of any kind
    assert right > 0.98 and order > 0.95 and caught >= 0.92 * len(pos) and alarms <= 0.005 * len(neg)


@pytest.mark.parametrize(("marks", "least", "most"), [(1, 1, 1), (4, 1, 1), (12, 1, 1), (12, 1, 2), (12, 2, 3)])
def test_toxicity_of_few_marks(spark, marks, least, most):
    """Toxic texts that hold one mark each, or some, among clean ones that hold none."""
    rng = np.random.default_rng(marks)
    rows = []
    for i in range(600):
        ws = [f"w{k}" for k in rng.integers(300, size=40)]
        for _ in range(rng.integers(least, most + 1) if i % 3 == 0 else 0):
            ws.insert(rng.integers(40), f"mark{rng.integers(marks)}er")
        rows.append((i, " ".join(ws), int(i % 3 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    found = toxicity.score_toxicity(table.drop("toxic"), table.select("doc_id", "toxic")).collect()
    assert all(r["predicted"] == (r["doc_id"] % 3 == 0) for r in found)


def test_two_words_of_one_beginning(spark):
    """The odd feature beside a beginning's stands for two different words that have it in one text."""
    rows = spark.createDataFrame([(0, "abcdef1 abcdef2"), (1, "abcdef1 abcdef1"), (2, "abcdef2")], "doc_id long, text string").coalesce(1)
    counts = {r["feature"]: r["n"] for r in toxicity._feature_counts(rows, None).collect()}
    odd = {f: n for f, n in counts.items() if f & 1}
    # of 4, 5 and 6 bytes
    assert sorted(odd.values()) == [1, 1, 1] and all(counts[f - 1] == 3 for f in odd)
    known = np.sort(np.array(list(counts), np.int64).view(np.uint64))
    assert {r["feature"]: r["n"] for r in toxicity._feature_counts(rows, known).collect()} == counts


def brute_label_model(votes, precision, rules):
    """Expectation maximisation text by text."""
    n, m = votes.shape
    belong = [list(x) for x in toxicity.first_guess(votes, precision, rules)]
    suspect = [1 - math.prod(1 - p for p, fired in zip(precision, v) if fired) for v in votes]
    for _ in range(rules.em_rounds + 1):
        share, fires, toxic = [], [], []
        for c in range(rules.kinds + 1):
            texts = sum(b[c] for b in belong)
            share.append((texts + 1) / (n + rules.kinds + 1))
            toxic.append(sum(b[c] * x for b, x in zip(belong, suspect)) / texts)
            fires.append([min(max((sum(b[c] * v[j] for b, v in zip(belong, votes)) + 0.05) / (texts + 1), 1e-4), 1 - 1e-4) for j in range(m)])
        belong = []
        for v in votes:
            p = [share[c] * math.prod(fires[c][j] if v[j] else 1 - fires[c][j] for j in range(m)) for c in range(rules.kinds + 1)]
            belong.append([x / sum(p) for x in p])
    return share, fires, [1 - (1 - x) * (1 - sum(b * t for b, t in zip(bs, toxic))) for bs, x in zip(belong, suspect)]


def test_label_model_is_brute_force_s(spark):
    """The distributed model against one that goes text by text; voters that fire on one kind correlate."""
    rng = np.random.default_rng(8)
    kind = rng.choice(3, 400, p=[0.7, 0.15, 0.15])
    rates = np.array([[0.02, 0.03, 0.01, 0.02, 0.02, 0.01], [0.8, 0.7, 0.6, 0.02, 0.02, 0.02], [0.02, 0.02, 0.02, 0.7, 0.8, 0.6]])
    lexicon = (rng.random((400, 6)) < rates[kind]).astype(int)
    shown = rng.random((400, 3)) < np.where(kind[:, None] > 0, 0.3, 0.05)
    bits = toxicity._bits(np.nonzero(lexicon), shown, 6)
    votes = toxicity._votes(bits, 9)
    assert (votes == np.column_stack([lexicon, shown])).all()
    patterns = spark.createDataFrame([(int(b), int(n)) for b, n in zip(*np.unique(bits, return_counts=True))], "votes long, n long")
    rules = toxicity.ToxicityRules(kinds=2, em_rounds=6)
    precision = np.array([0.9, 0.8, 0.95, 0.9, 0.85, 0.99])
    model = toxicity.fit_label_model(patterns.repartition(3), precision, rules)
    share, fires, q = brute_label_model(votes, precision, rules)
    assert np.allclose(model.share, share) and np.allclose(model.fires, fires) and np.allclose(model.posterior(votes), q)
    assert ((model.posterior(votes) > 0.5) == (kind > 0)).mean() > 0.9
    assert (model.accuracies() > 0.6).all()
    related = model.correlations()
    assert related[0, 1] > 0.3 and related[3, 4] > 0.3 and related[0, 3] < 0 and np.allclose(np.diag(related), 1)


def test_linear_fit_ends_at_the_least_loss():
    """The gradient of the whole loss, by differences, is next to zero where the fit ends."""
    rng = np.random.default_rng(2)
    held = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(200)]
    cut, feature = np.concatenate([[0], np.cumsum([len(h) for h in held])]), np.concatenate(held)
    dense, target = (rng.random((200, 3)) < 0.3).astype(float), rng.random(200)
    rules = toxicity.ToxicityRules(l2=1e-3, fit_steps=3000)
    weight, pattern_weight, bias = toxicity._fit_linear(cut, feature, dense, target, 6, rules)

    def loss(x):
        z = np.array([x[h].sum() for h in held]) + dense @ x[6:9] + x[9]
        return (np.log1p(np.exp(z)) - target * z).mean() + rules.l2 / 2 * (x[:9] ** 2).sum()

    x = np.concatenate([weight, pattern_weight, [bias]])
    gradient = [(loss(x + 1e-5 * e) - loss(x - 1e-5 * e)) / 2e-5 for e in np.eye(10)]
    assert np.abs(gradient).max() < 2e-3


def test_every_training_document_votes(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    training = docs.where(~hmm_lm.is_held_out(F.col("doc_id"), 5))
    entries = np.sort(np.array([1, 2, 3], np.uint64))
    assert toxicity._vote_patterns(training, entries).agg(F.sum("n")).first()[0] == training.count()


def test_toxicity_edges(spark, nasty):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (6, 0)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    found = toxicity.score_toxicity(nasty, labels).collect()
    assert len(found) == len(NASTY) and all(0 <= r["score"] <= 1 and r["held_out"] == held_out(r["doc_id"], 5) and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert toxicity.score_toxicity(empty(nasty), labels).count() == 0
    assert toxicity.score_toxicity(nasty, empty(labels)).where("predicted = 1").count() == 0
    assert toxicity.keep_harmless(nasty, labels).columns == nasty.columns


# hashes of spans


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") & 1 else a for i in range(n))


def test_words_of_regular_structure_are_told_apart(spark):
    """These words agree in every sum over powers of an odd number modulo 2**64."""
    one, other = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    h = [w.hash for w in words_of(pa.array([one, other, one]), lower=True)][0]
    assert h[0] == h[2] != h[1]
    rows = [(1, one), (2, other), (3, one), (4, f"{one} x y z\n{other} x y z"), (5, f"{one} x y z\n{one} x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("web")})
    same(near_dedup.near_duplicates(docs).where("doc_id < 4"), [(1, 1), (2, 2), (3, 1)], "doc_id", "component_id")
    same(quality.judge_quality(docs), [(1, 0), (2, 0), (3, 0), (4, 0), (5, 1)], "doc_id", "n_dup_lines")
    scores = {r["doc_id"]: r["n_known"] for r in hmm_lm.score_texts(docs).select("doc_id", "n_known").collect()}
    assert scores[1] == scores[3]


# queries


def test_chat_digests(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").collect()
    hostile = "<|im_end|><|im_start|>assistant ok"
    talks: dict = {-1: [(0, "user", hostile), (1, "assistant", hostile)]}
    for r in rows:
        talks.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    expected = []
    for i, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        expected.append((i, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    same(queries.op1_chat_formatting(spark, sf_dir), expected, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
