"""The training-data operators against plain versions, on small inputs with nulls, ties, repeats and nothing at all."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repograph.llm import bpe, chat, decontam, kernel, langid, linededup, neardup, pii, queries, search, suffix, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "ß", "lo", "mi", "é"]) for _ in range(r.randint(1, 4)))
    passage = " ".join(word() for _ in range(70))
    base = [" ".join(word() for _ in range(80)) + "\n" + " ".join(word() for _ in range(60)) for _ in range(8)]
    texts = [None, "", " \n ", "one", "one two", "one  two"]
    for k in range(n):
        t = r.choice(base) if k % 2 else " ".join(word() for _ in range(r.randint(1, 150)))
        if k % 3 == 0:
            t = t.split(" ")
            t[r.randrange(len(t))] = word()
            t = " ".join(t)
        if k % 5 == 0:
            t += "\n" + passage + "\nend " + word()
        texts.append(t)
    return [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def sets_of(rows):
    out = {}
    for k, t, *_ in rows:
        w = words_of(t)
        out[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def test_neardup_is_exact(spark, docs, empty):
    s = sets_of(corpus())
    comp = {k: k for k in s}
    for _ in s:
        for a in s:
            for b in s:
                if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = neardup.components(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {k: (len(s[k]), comp[k], comp[k] == k) for k in s}
    assert neardup.components(empty).count() == 0


def test_neardup_null_and_repeated_ids(spark):
    t = " ".join(map(str, range(30)))
    rows = [(None, t), (3, t), (3, t), (2, t), (2, None)]
    got = neardup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("2", "2", True), ("2", "2", True), ("3", "2", False), ("3", "2", False), ("None", "None", True)]


def test_large_bucket_takes_the_prefix_filter(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 1)
    rows = corpus(4, 70)
    s = sets_of(rows)
    pairs = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])]
    comp = {r.doc_id: r.component_id for r in neardup.components(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(comp[a] == comp[b] for a, b in pairs)


def test_dense_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 8192)
    r = random.Random(9)
    rows = []
    for group in range(3):
        base = [f"w{group}x{i}" for i in range(120)]
        for k in range(60):
            t = list(base)
            for _ in range(r.randint(1, 6)):
                t[r.randrange(len(t))] = f"e{r.random()}"
            rows.append((len(rows), " ".join(t), "en", "s", 1))
    s = sets_of(rows)
    comp = {k: k for k in s}
    linked = [(a, b) for a in s for b in s if a != b and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])]
    for _ in range(20):
        for a, b in linked:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {x.doc_id: x.component_id for x in neardup.components(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(set(comp.values())) > 6
    assert got == comp


def plain_removal(rows):
    seen, want = Counter(), []
    for _, t, *_ in rows:
        b = (t or "").encode()
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    for k, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        want.append((k, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)))
    return Counter(want)


def removal(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(df).collect())


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


def test_suffix_removal(spark, empty):
    rows = corpus() + [(1000, "ab" * 300, "x", "s", 1), (1001, "q" * 200, "x", "s", 1), (1002, "q" * 199, "x", "s", 1), (None, corpus()[9][1], "x", "s", 1), (7, "q" * 200, "x", "s", 1), (7, "q" * 200, "x", "s", 1), (8, "\0" * 250, "x", "s", 1), (9, "\0" * 260, "x", "s", 1)]
    assert removal(spark.createDataFrame(rows, DOCS).repartition(3)) == plain_removal(rows)
    assert suffix.remove_repeats(empty).count() == 0


def test_strings_that_collide_under_powers_of_two(spark):
    r = random.Random(6)
    rows = [(k, t) for k, t in enumerate(x for n in (1024, 2048, 4096, 8192) for x in (thue_morse(n), thue_morse(n, "b", "a"), thue_morse(n, "x", "y"), thue_morse(n, "y", "x")))]
    noise = "".join(chr(r.randrange(33, 120)) for _ in range(8192))
    rows += [(100 + k, "".join(x + y for x, y in zip(thue_morse(8192, *ab), noise))) for k, ab in enumerate(["ab", "ba"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert removal(df) == plain_removal(rows)
    assert removal(df.where("doc_id >= 100")) == Counter((k, 16384, 0, 0, t.encode()) for k, t in rows[-2:])


def test_collisions_start_anew(spark, monkeypatch):
    seen = []
    plain = suffix._attempt
    monkeypatch.setattr(suffix, "ATTEMPTS", ((101, 102, 3), *suffix.ATTEMPTS))
    monkeypatch.setattr(suffix, "_attempt", lambda *a: seen.append(x := plain(*a)) or x)
    rows = corpus(3)
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 4096)
    assert removal(spark.createDataFrame(rows, DOCS).repartition(4)) == plain_removal(rows)
    assert seen[0] is None and len(seen) == 2
    monkeypatch.setattr(suffix, "ATTEMPTS", ((101, 102, 3),))
    with pytest.raises(RuntimeError):
        suffix.remove_repeats(spark.createDataFrame(rows, DOCS))


def test_nothing_is_left_behind(spark, docs):
    suffix.remove_repeats(docs).count()
    kernel.clear()
    assert not kernel._written and not [t for t in spark.catalog.listTables() if t.name.startswith("blocks_")]


def test_cover_is_perfect():
    assert len({(i - j) % suffix.PERIOD for i in suffix.COVER for j in suffix.COVER}) == suffix.PERIOD


def plain_line_dedup(rows, least=50):
    """By all shortest runs; rows equal in id and text are one, null ids come first (of one text at most here)."""
    places, grams = {}, {}
    for k, t, *_ in {r[:2]: r for r in rows}.values():
        lines = [(i, x.strip(" \t\x0b\x0c\r")) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\x0b\x0c\r")]
        n = [len(x.encode().split()) for _, x in lines]
        own = set()
        for a in range(len(lines)):
            own |= {(a, b) for b in [next((b for b in range(a, len(lines)) if sum(n[a : b + 1]) >= least), None)] if b is not None}
            own |= {(b, a) for b in [next((b for b in range(a, -1, -1) if sum(n[b : a + 1]) >= least), None)] if b is not None}
        for a, b in own:
            key = tuple(x for _, x in lines[a : b + 1])
            places.setdefault(key, []).append((-1 if k is None else k, lines[a][0]))
            grams.setdefault((k, t), []).append((key, lines[a][0], lines[b][0]))
    out = []
    for k, t, *_ in rows:
        gone = {i for key, a, b in grams.get((k, t), []) if min(places[key]) != (-1 if k is None else k, a) for i in range(a, b + 1)}
        out.append((k, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)))
    return Counter(out)


def lines_left(df):
    return Counter((r.doc_id, r.text) for r in linededup.dedup_lines(df).collect())


def test_line_dedup(spark, docs, empty):
    got = linededup.dedup_lines(docs.withColumn("n_removed_lines", F.lit(7)))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == plain_line_dedup(corpus())
    assert got.where("n_removed_lines <> 7").count() == 0
    assert linededup.dedup_lines(empty).count() == 0
    assert linededup.dedup_lines(docs).columns == [*docs.columns, "n_removed_lines"]


def lined(seed=3):
    """Texts put together from few lines of 5 to 120 words, blank lines and blanks around lines among them."""
    r = random.Random(seed)
    pool = [" ".join(f"w{r.randrange(400)}" for _ in range(r.choice([5, 17, 30, 60, 120]))) for _ in range(9)] + ["", " ", "x"]
    runs = [[r.choice(pool) for _ in range(6)] for _ in range(6)]
    rows = []
    for k in range(70):
        t = []
        for _ in range(r.randrange(5)):
            t += r.choice(runs) if r.random() < 0.6 else [r.choice(pool) for _ in range(3)]
        rows.append((k, "\n".join(r.choice(["", " ", "\t"]) + x + r.choice(["", "\r", " "]) for x in t)))
    return rows + [(None, rows[5][1]), (None, None), (3, rows[3][1]), (3, rows[3][1]), (4, None), (-5, rows[9][1])]


def test_line_dedup_blank_lines_ties_and_null_ids(spark):
    rows = lined()
    assert lines_left(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == plain_line_dedup(rows)


def test_line_dedup_compares_lines(spark):
    rows = [(k, t) for k, t in enumerate(x for n in (1024, 2048) for x in (thue_morse(n, "a ", "b "), thue_morse(n, "b ", "a "), thue_morse(n, "p q\n", "r s\n"), thue_morse(n, "r s\n", "p q\n")))]
    assert lines_left(spark.createDataFrame(rows, "doc_id long, text string")) == plain_line_dedup(rows)


def test_line_dedup_starts_anew_on_collisions(spark, monkeypatch):
    monkeypatch.setattr(linededup, "ATTEMPTS", ((201, 202, 1), *linededup.ATTEMPTS))
    rows = lined(8)
    assert lines_left(spark.createDataFrame(rows, "doc_id long, text string")) == plain_line_dedup(rows)
    monkeypatch.setattr(linededup, "ATTEMPTS", ((201, 202, 1),))
    with pytest.raises(RuntimeError):
        linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))


def test_line_dedup_keeps_columns_whatever_their_names(spark, docs):
    names = ["runs", "__mark", "spot", "rest", "gone", "mark", "n_removed", "differs", "g_doc", "a.b", "_"]
    more = docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    got = linededup.dedup_lines(more)
    assert got.columns == [*more.columns, "n_removed_lines"]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == plain_line_dedup(corpus())
    assert got.select(*(F.col(f"`{n}`") for n in names)).distinct().collect() == [tuple(range(len(names)))]


def test_decontamination(spark, docs, empty):
    items = [(1, corpus()[11][1]), (2, "one two"), (3, None), (4, "!!"), (None, "end")]
    items_df = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = [(i, tuple(own[k : k + 10])) for i, t in items if (own := w(t)) for k in range(max(1, len(own) - 9))]
    want = {}
    for k, t, *_ in corpus():
        own, hit, ids = w(t), set(), set()
        for i, x in wins:
            for a in range(len(own) - len(x) + 1):
                if tuple(own[a : a + len(x)]) == x:
                    hit |= set(range(a, a + len(x)))
                    ids |= {str(i)} - {"None"}
        want[k] = len(own), len(hit), sorted(ids)
    for most in (500_000, 1):
        got = decontam.find_contamination(docs, items_df, most).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == want
    assert decontam.clean_rows(docs, items_df).count() == sum(not v[1] for v in want.values())
    assert decontam.find_contamination(empty, items_df).count() == 0
    assert decontam.find_contamination(docs, items_df.where("false")).where("n_hit > 0").count() == 0


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    path, pattern = queries.vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks(path), special_tokens={})


def odd_text(r, n):
    return "".join(r.choice(["a", "é", " ", "  ", "\n", "1", "'s", "!", "the ", "漢", "x" * r.randint(1, 40)]) for _ in range(n))


def test_bpe_round_trip(spark, docs, empty, tiktoken_encoding):
    path, pattern = queries.vocabulary()
    r = random.Random(4)
    texts = [t or "" for _, t, *_ in corpus()] + [odd_text(r, 400), "z" * 3000, "a b" * 900, " " * 2000]
    rows = list(enumerate(texts)) + [(None, texts[-1]), (0, texts[-4]), (0, texts[-4]), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter((k, tuple(tiktoken_encoding.encode_ordinary(t or "")), t or "") for k, t in rows)
    for chunk, overlap in ((bpe.CHUNK, bpe.OVERLAP), (60, 15)):
        got = bpe.decode(bpe.encode(df, path, pattern, chunk, overlap), path).collect()
        assert Counter((x.doc_id, tuple(x.ids), bytes(x.data).decode()) for x in got) == want
    assert bpe.encode(empty, path, pattern).count() == 0
    nothing = bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), path).collect()
    assert [bytes(x.data) for x in nothing] == [b"", b""]


def test_merging_is_by_rank(tiktoken_encoding, tmp_path):
    path, _ = queries.vocabulary()
    r = random.Random(3)
    # Letters only, so each is one pre-token.
    pieces = ["".join(r.choice("aaeinrstlo\u00e9") for _ in range(r.choice([1, 2, 3, 7, 20, 64, 65, 90]))) for _ in range(1500)]
    assert bpe.merged([x.encode() for x in pieces], path) == [tiktoken_encoding.encode_ordinary(x) for x in pieces]
    assert bpe.merged([], path) == []
    import base64

    tokens = [bytes([c]) for c in range(256)] + [b"ab", b"ba", b"aba", b"bab", b"abab", b"aa"]
    own = tmp_path / "ranks"
    own.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
    known = {t: k for k, t in enumerate(tokens)}

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            pairs = [(known[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in known]
            if not pairs:
                return [known[x] for x in parts]
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    every = [bytes(97 + (bits >> i & 1) for i in range(n)) for n in range(1, 10) for bits in range(2**n)]
    want = [[known[x]] if x in known else plain(x) for x in every]
    assert bpe.merged(every, str(own)) == want
    assert [bpe._merged_long(x, known) for x in every] == [plain(x) for x in every]


def test_chunks_stitch_anywhere():
    import regex

    m, r = regex.compile(queries.vocabulary()[1]), random.Random(2)
    for _ in range(400):
        s = odd_text(r, r.randint(0, 90))
        chunk, overlap = r.randint(3, 20), r.randint(2, 10)
        cut = [bpe.boundaries(m, s, a, min(len(s), a + chunk + overlap)) for a in range(0, len(s), chunk)]
        line = bpe.stitched(m, s, cut, chunk, overlap) if cut else [0]
        assert [s[a:b] for a, b in zip(line, line[1:])] == m.findall(s)


def test_pre_tokens_all_at_once(tiktoken_encoding):
    """Of all characters, as tiktoken tells letters, numbers and blanks; of odd rows side by side, as it encodes each."""
    import regex
    import tiktoken

    path, pattern = queries.vocabulary()
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kind = np.full(0x110000, 3)
    for k, p in enumerate((r"\s", r"\p{L}", r"\p{N}")):
        told = tiktoken.Encoding("own", pat_str=p, mergeable_ranks={bytes([c]): c for c in range(256)}, special_tokens={})
        kind[[ord(c) for c in bytes(told.encode_ordinary(every)).decode()]] = k
    kind[0xD800:0xE000] = bpe.kinds()[0xD800:0xE000]
    assert (bpe.kinds() == kind).all()
    r = random.Random(6)
    odd = ["'", "'", "'s", "'re", "'l", "'ll", "'ve", "'d", "re", "T", " ", "  ", "\n", "\x85", "\u3000", "\xb2", "1", "!", "\u0301", "\x00", "\U0001f600", "\U0003e374", "\u0558", "-" * 70, "xy" * 33]
    texts = [None, "", *("".join(r.choice(odd) for _ in range(r.randint(0, 12))) for _ in range(4000)), "".join(map(chr, range(0x400))), "".join(map(chr, range(0x400, 0x800)))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    for matcher in (regex.compile(pattern), regex.compile(pattern + "|x")):
        for t in kernel.slices(iter([batch]), "text"):
            raw, at, rows = bpe.pieces_of(matcher, t)
            ids, ends = bpe.ids_of(raw, at, path)
            for i, (a, b) in enumerate(zip(ends[rows], ends[rows[1:]])):
                s = t.text(i).decode()
                if matcher.pattern == pattern or not {"\U0003e374", "\u0558"} & set(s) and s.isascii():
                    assert ids[a:b].tolist() == tiktoken_encoding.encode_ordinary(s)


def test_equal_digests_are_told_apart(tiktoken_encoding, monkeypatch):
    path, _ = queries.vocabulary()
    monkeypatch.setattr(kernel, "mix", lambda x: x % np.uint64(3))
    pieces = [x.encode() for x in ("ab", "ab\x00", "abc", "ab", "abcdefgh", "abcdefghi", "abcdefghj", "abcdefghi", "z" * 70, "z" * 70)]
    ids, ends = bpe.ids_of(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)]), path)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == bpe.merged(pieces, path)


def plain_search(vectors, queries, k):
    """{(query id, rank, vector id, score)} of {(id, components)}: a pair of ids has its best score."""
    score = {}
    for q, x in queries:
        for v, y in vectors:
            if q != v:
                n = sum(a * b for a, b in zip(x, y))
                score[q, v] = max(n, score.get((q, v), n))
    out = set()
    for q in {q for q, _ in queries}:
        own = sorted((-n, v) for (p, v), n in score.items() if p == q)[:k]
        out |= {(q, r, v, -n) for r, (n, v) in enumerate(own, 1)}
    return out


def searched(*args, **more):
    return {(a.query_id, a.rank, a.vec_id, a.score) for a in search.top_k(*args, **more).collect()}


def test_search_is_exact(spark):
    r = np.random.default_rng(0)
    v = [(k, [float(x) for x in r.normal(size=8).round(1)]) for k in range(300)] + [(900, None), (901, [float("nan")] * 8), (902, [None] * 8), (903, []), (None, [1.0] * 8), (905, [float("inf")] * 8)]
    q = search.quantise(spark.createDataFrame(v, "vec_id long, embedding array<float>"))
    x = [(k, np.floor(64 * np.array(a, np.float32).astype(float)).astype(int).tolist()) for k, a in v[:300]]
    want = plain_search(x, [a for a in x if a[0] % 20 == 0], 5)
    asked = q.where("vec_id % 20 = 0")
    assert searched(q, asked, 5) == want
    assert searched(q, asked, 5, max_queries=4, max_sample=3) == want
    assert searched(q.repartition(5), asked, 400, max_sample=50) == plain_search(x, [a for a in x if a[0] % 20 == 0], 400)
    assert not searched(q.where("false"), asked, 5) and not searched(q, q.where("false"), 5)


def test_search_repeats_lengths_and_bounds(spark):
    make = lambda rows: spark.createDataFrame([(k, [float(c) for c in x]) for k, x in rows], "vec_id long, q array<double>")
    v = [(k % 40, [(k * 7) % 5, k % 3, 1][: 1 + k % 3]) for k in range(90)] + [(50, [2, 2, 2])] * 30
    asked = [(0, [1, 1, 1, 4]), (0, [2, 0]), (50, [1]), (99, [0, 0, 0])]
    assert searched(make(v), make(asked), 6) == plain_search(v, asked, 6)
    with pytest.raises(ValueError):
        searched(make([(1, [2**40]), (2, [1])]), make([(2, [2**20])]), 2)


def test_search_stops(spark):
    """Two far clusters: queries of one don't read the other."""
    r = np.random.default_rng(1)
    rows = [(k, (r.normal(size=4).round(2) + (40 if k % 2 else -40)).tolist()) for k in range(4000)]
    q = search.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert search.top_k(q, q.where("vec_id % 20 = 0"), 5).first().share_read < 0.7


def test_chat_reads_back(spark):
    rows = [(1, 0, "user", "a<|end|>b<\\|x"), (1, 1, "assistant", "</s><|next|>"), (1, 2, "assistant", ""), (1, 3, "assistant", "z"), (2, 5, None, None), (None, 1, "<|says|>", "é"), (2, 5, None, None)]
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [tuple(t) for t in out[1].turns] == [r[2:] for r in rows[:4]] and out[1].loss_text == "</s><|next|>z"
    assert [tuple(t) for t in out[2].turns] == [("", "")] * 2 and out[2].loss_text == ""
    assert [tuple(t) for t in out[None].turns] == [("<|says|>", "é")]


def test_language_and_defined_results(spark, empty):
    r = random.Random(3)
    kinds = {"aa": "the and tion ing er".split(), "bb": "der und keit sch ung".split()}
    rows = [(k, " ".join(r.choice(kinds[lang]) + r.choice(kinds[lang]) for _ in range(30)), lang) for k in range(80) for lang in [("aa", "bb")[k % 2]]]
    df = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 !", "bb"), (902, "", None)], "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 4 <> 2"))
    got = {x.doc_id: x for x in langid.identify(df, model).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows if k % 4 == 2)
    assert all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in (900, 901, 902))
    assert {x.lang_pred for x in langid.identify(df, langid.fit(empty)).collect()} == {"und"}


def test_toxicity(spark, empty):
    r = random.Random(5)
    word = lambda: "".join(r.choice(["an", "er", "lo", "mi", "ta"]) for _ in range(3))
    rows = [(k, " ".join([word() for _ in range(20)] + (["worthless", "pathetic"] if k % 4 == 0 else [])), int(k % 4 == 0)) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df)
    more = spark.createDataFrame([(1, "you are wortless and patetic"), (2, "he said the word \"worthless\" again"), (3, "anermi lota"), (4, None), (5, "you are worthless and pathetic")], "doc_id long, text string")
    s = {x.doc_id: x.score for x in toxicity.score(more, model).collect()}
    assert s[5] > 0.5 and s[1] > 0.5 and s[3] < 0.5 and s[4] == s[3] and s[2] < s[5]
    assert toxicity.score(more, toxicity.fit(empty.withColumn("toxic", F.lit(1)))).where("score > 0.01").count() == 0


def test_automaton_is_levenshtein():
    a = toxicity.automaton({"moron": 1, "worthless": 2}, ["réeu"])

    def distance(s, t):
        d = list(range(len(t) + 1))
        for i, x in enumerate(s, 1):
            d, last = [i], d
            for j, y in enumerate(t, 1):
                d.append(min(last[j] + 1, d[j - 1] + 1, last[j - 1] + (x != y)))
        return d[-1]

    r = random.Random(1)
    for _ in range(1500):
        s = list(r.choice(["moron", "worthless", "réeux"]))
        for _ in range(r.randint(0, 3)):
            s[r.randrange(len(s))] = r.choice(["", "x", "o", "rr"])
        s = "".join(s) or "x"
        near = [d for t, k in (("moron", 1), ("worthless", 2)) if (d := distance(s, t)) <= k]
        want = 1 if s.startswith("réeu") else 1 + min(near) if near else 0
        point = np.array([ord(c) for c in s], np.uint32)
        assert toxicity.run_automaton(a, point, np.array([0]), np.array([len(s)]))[0] == want, s


def plain_pii(t):
    out, luhn = [], pii.luhn
    for kind, p, ok in (
        (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        (2, r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)), (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(p, t) if ok(m[0])]
    return out


def test_pii_base_is_exact():
    r = random.Random(8)
    for _ in range(300):
        s = pii.labelled_text(r)[0] + "".join(r.choice("a1.@-+ %") for _ in range(40))
        assert pii.base_spans(s) == plain_pii(s), s


def small_tagger():
    m = pii.Tagger(seed=5, size=3, hidden=2)
    r = np.random.default_rng(6)
    m.p = {k: (v + r.normal(size=v.shape) * 0.4).astype(np.float32) for k, v in m.p.items()}
    return m


def paths_scores(m, s):
    """The score of each way of tagging, over all ways."""
    import itertools

    return {w: sum(float(s[t, k]) for t, k in enumerate(w)) + sum(float(m.p["t"][a, b]) for a, b in zip(w, w[1:])) for w in itertools.product(range(pii.TAGS), repeat=len(s))}


def test_crf_sums_and_gradient():
    m, r = small_tagger(), np.random.default_rng(7)
    chars, tags = r.integers(0, pii.CLASSES, (2, 4)).astype(np.uint8), r.integers(0, pii.TAGS, (2, 4))
    s = m.scores(chars)
    want = 0.0
    for b in range(2):
        every = paths_scores(m, s[b])
        want += np.log(sum(np.exp(v) for v in every.values())) - every[tuple(tags[b])]
    loss, grad = m.gradient(chars, tags)
    assert loss == pytest.approx(want / 8, rel=1e-4)
    for name, x in m.p.items():
        for place in {tuple(r.integers(0, n) for n in x.shape) for _ in range(6)}:
            kept, sides = x[place], []
            for step in (1e-2, -1e-2):
                x[place] = kept + step
                sides.append(m.gradient(chars, tags)[0])
            x[place] = kept
            assert grad[name][place] == pytest.approx((sides[0] - sides[1]) / 2e-2, abs=2e-3), (name, place)


def test_decoding_is_the_best_way():
    m, r = small_tagger(), np.random.default_rng(8)
    whole = r.normal(size=(30, 4, pii.TAGS)).astype(np.float32) * 2
    size = r.integers(1, 5, 30)
    got = m.decode(np.ascontiguousarray(whole.transpose(2, 1, 0)), size)
    allowed = lambda w: w[0] % 2 * w[0] == w[0] and all(pii._FORBIDDEN[a, b] == 0 for a, b in zip(w, w[1:]))
    for i, n in enumerate(size):
        every = {w: v for w, v in paths_scores(m, whole[i, :n]).items() if allowed(w)}
        assert tuple(got[i, :n]) == max(every, key=every.get)


def test_emissions_and_hope():
    """The quick scores are the plain ones; where decoding of the whole finds a span, there was hope."""
    m, r = pii.trained(), random.Random(9)
    chars = np.random.default_rng(1).integers(0, pii.CLASSES, (40, 70)).astype(np.uint8)
    assert np.allclose(m.emissions(chars).transpose(2, 1, 0), m.scores(chars), atol=1e-4)
    for _ in range(20):
        c = pii.classes(pii.labelled_text(r)[0])
        bounds = np.array([0, len(c)])
        s = pii.reconciled(m, c, bounds)
        best = m.decode(np.ascontiguousarray(s)[:, :, None])[0]
        assert (m.hopeful(s, bounds) | (best == 0)).all()


def test_emissions_look_up_characters_only(monkeypatch):
    """Of each character its embedding is gathered once for each direction, not all gates; scores are the plain ones, in long runs of one class too."""
    m, gathered, take = pii.trained(), [], np.take
    chars = np.random.default_rng(2).integers(0, pii.CLASSES, (33, pii.WINDOW)).astype(np.uint8)
    chars[:3] = np.array([[0], [28], [pii.CLASSES - 1]])
    monkeypatch.setattr(pii.np, "take", lambda a, *rest, **more: (gathered.append(np.size(x := take(a, *rest, **more))), x)[1])
    got = m.emissions(chars)
    monkeypatch.undo()
    assert np.allclose(got.transpose(2, 1, 0), m.scores(chars), atol=1e-4)
    assert sum(gathered) <= 2 * chars.size * m.p["e"].shape[1]


# Sentences that no template makes: (text, kind, what is to be found).
SENTENCES = [
    ("Kontakt: jana.krause at posteo dot de, danke!", "email", "jana.krause at posteo dot de"), ("You can reach me under m.weber (at) firma-nord (dot) org any time.", "email", "m.weber (at) firma-nord (dot) org"),
    ("Write to firstname.lastname at averylonghostname dot com today", "email", "firstname.lastname at averylonghostname dot com"), ("escribe a LUCIA.PEREZ [AT] CORREO [DOT] COM por favor", "email", "LUCIA.PEREZ [AT] CORREO [DOT] COM"),
    ("Call our office, (415) 555-2671, before noon.", "phone", "(415) 555-2671"), ("Tel. 0049 171 2345678 ou par courrier", "phone", "0049 171 2345678"), ("dial 202-555-0143 and ask", "phone", "202-555-0143"),
    ("the gateway is 10 . 0 . 12 . 1 as ever", "ip", "10 . 0 . 12 . 1"), ("we blocked 203[.]0[.]113[.]9 yesterday", "ip", "203[.]0[.]113[.]9"), ("paid with 4111/1111/1111/1111 in May", "card", "4111/1111/1111/1111"),
]
CLEAN = ["Meet me at the station, or at home, and dot your i's.", "Version 1.2.3 came out on 2021-03-04 at 10:45.", "In 1984, 250,000 people lived at an altitude of 1200 m.", "ISBN 3-16-148410-0, page 12, price 12.50 EUR", "look at example and at dot", "order 48211 item 7 of 19"]


def test_pii_model_adds(spark):
    m = pii.trained()
    r, found, wanted, added = random.Random(77), 0, 0, 0
    for _ in range(60):
        s, spans = pii.labelled_text(r)
        base = pii.base_spans(s)
        more = pii.model_spans(m, [s], [base])[0]
        assert not any(a < y and x < b for _, a, b in more for _, x, y in base)
        wanted += len(set(spans) - set(base))
        found += len(set(spans) & set(more))
        added += len(more)
    assert found > 0.85 * wanted and found > 0.95 * added
    hits = sum((kind, text) in {(pii.KINDS[k], s[a:b]) for k, a, b in pii.model_spans(m, [s], [pii.base_spans(s)])[0]} for s, kind, text in SENTENCES)
    assert hits >= 8
    assert not any(pii.model_spans(m, [s], [pii.base_spans(s)])[0] for s in CLEAN)
    got = pii.find(spark.createDataFrame([(1, None), (2, "a.b@c.de"), (2, "x " * 3000 + SENTENCES[5][0]), (None, "")], "doc_id long, text string")).collect()
    assert sorted((str(x.doc_id), [tuple(s) for s in x.base], len(x.added)) for x in got) == [("1", [], 0), ("2", [], 1), ("2", [("email", 0, 8)], 0), ("None", [], 0)]


def test_pii_spans_do_not_depend_on_the_place():
    """A span is found wherever window and piece bounds fall, and whatever texts are beside it."""
    m, (s, _, want) = pii.trained(), SENTENCES[5]
    words = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore "
    texts = [words[:k] + words * 3 + "\n" + s + "\n" + words for k in range(0, 97, 6)]
    alone = [pii.model_spans(m, [t], [[]])[0] for t in texts]
    assert alone == pii.model_spans(m, texts, [[] for _ in texts])
    assert sum(want in {t[a:b] for _, a, b in own} for t, own in zip(texts, alone)) >= 0.9 * len(texts)


def shuffled(spark):
    """Bytes that the session has written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_near_dedup_shuffles_no_texts_that_stay(spark):
    import corpus_pipeline

    r = random.Random(31)
    words = lambda n: " ".join(f"{r.getrandbits(48):x}" for _ in range(n))
    rows = [(k, words(700)) for k in range(200)]
    rows += [(1000 + k, rows[k][1] + " more") for k in range(5)] + [(None, rows[0][1]), (3, rows[3][1] + " other")]
    path = f"{kernel.shared_dir(spark)}/few-copies"
    spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("__id"), F.lit(2).alias("part"), F.lit(3).alias("map"), F.lit(4).alias("a.b")).write.parquet(path)
    docs, threshold, before = spark.read.parquet(path), spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.near_dedup(spark, docs, "")
        assert out.columns == docs.columns
        got = [(x.doc_id, x.text) for x in out.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted(got, key=str) == sorted((x for x in rows if x[0] is None or x[0] < 1000), key=str)
    # Once the texts of all rows went through two shuffles.
    assert shuffled(spark) - before < 0.5 * sum(len(x) for _, x in rows)


def test_held_by_a_bitmap(spark, monkeypatch):
    df = spark.createDataFrame([(str(k) if k % 50 else None, k) for k in range(20_000)], "doc_id string, k int")
    for bits, step in ((1 << 25, 40), (1 << 15, 3), (1 << 25, 10**9)):
        monkeypatch.setattr(kernel, "MOST_BITS", bits)
        ids = kernel.stored(spark.createDataFrame([(str(k),) for k in range(1, 20_000, step)] + [("none",), (None,)], "id string"))
        inside, outside = ({x.k for x in kernel.held(df, ids, side).collect()} for side in (True, False))
        own = {k for k in range(1, 20_000, step) if k % 50}
        assert own <= inside and not inside & outside and inside | outside == set(range(20_000))
        assert bits < 1 << 25 or len(inside) < len(own) + 20_000 / 50 + 1500
    none = kernel.stored(ids.where("false"))
    assert kernel.held(df, none).count() == 0 and kernel.held(df, none, False).count() == 20_000


NAMES = ["score", "lang_pred", "runs", "__mark", "row", "n_hit", "n_words", "items", "__id", "comp", "key", "ids", "a.b", "_"]


def plain_pipeline(rows, items):
    """The stages by plain versions, for rows whose language is sure or which have no letter."""
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    kept = plain_line_dedup(rows)
    rows = [(k, t) for (k, t), n in kept.items() for _ in range(n)]
    s = sets_of(rows)
    comp = {k: k for k in s}
    for _ in s:
        for a in s:
            for b in s:
                if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {tuple(own[k : k + 10]) for t in items if (own := w(t)) for k in range(max(1, len(own) - 9))}
    hit = lambda own: any(tuple(own[a : a + len(x)]) == x for x in wins for a in range(len(own) - len(x) + 1))
    return {k: t for k, t in rows if comp[k] == k and not hit(w(t))}


def test_pipeline(spark, tmp_path, tiktoken_encoding):
    import corpus_pipeline as P

    rows = corpus(2, 40)
    docs = spark.createDataFrame(rows, DOCS).select("*", *(F.lit(k).alias(n) for k, n in enumerate(NAMES)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[11][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, kernel.stored(stage(spark, docs, str(tmp_path)))
        assert docs.columns == before.columns, name
        assert docs.where(" and ".join(f"`{n}` = {k}" for k, n in enumerate(NAMES))).count() == docs.count()
    got = {r.doc_id: (r.ids, r.decoded_sha256) for r in P.run(spark, str(tmp_path)).collect()}
    assert got == {k: (tiktoken_encoding.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for k, t in plain_pipeline(rows, [rows[11][1]]).items()}


def test_pipeline_of_nothing_and_nulls(spark, tmp_path):
    import corpus_pipeline as P

    schema = DOCS
    for n, rows in enumerate(([], [(None, None, None, None, None)] * 2 + [(None, "one two", None, None, 1), (3, "", None, None, 0)])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{n}/benchmark.parquet")
        assert P.run(spark, f"{tmp_path}/{n}").count() == 0


def test_long_texts(spark):
    """Every operator takes a text of some MB; what it finds is as for short ones."""
    r = random.Random(4)
    words = [f"w{k}" for k in range(4000)]
    long_ = "\n".join(" ".join(r.choice(words) for _ in range(12)) for _ in range(30_000))
    df = spark.createDataFrame([(1, long_), (2, long_), (3, "short text"), (None, long_[:2000])], "doc_id long, text string")
    got = {str(x.doc_id): x for x in neardup.components(df).collect()}
    assert got["2"].component_id == 1 and got["1"].n_shingles > 300_000 and got["3"].component_id == 3
    assert sorted(x.n_removed for x in suffix.remove_repeats(df).collect()) == [0, 2000, len(long_), len(long_)]
    assert {str(x.doc_id): len(x.text) for x in linededup.dedup_lines(df).collect()}["2"] == 0
    assert decontam.find_contamination(df, df.select(F.lit(1).alias("item_id"), F.lit(long_[:200]).alias("text"))).where("n_hit > 0").count() == 3
    path, pattern = queries.vocabulary()
    assert [x.n for x in bpe.decode(bpe.encode(df.where("doc_id = 1"), path, pattern), path).select(F.length("data").alias("n")).collect()] == [len(long_)]


def test_null_and_repeated_ids(spark, docs):
    rows = [(None, "a@b.cd one"), (None, None), (1, "the same text"), (1, "the same text"), (1, "another 10.0.0.1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = langid.Model([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), {n: (np.zeros(0, np.uint64), np.zeros((0, 0), np.float32)) for n in langid.ORDERS})
    ids = lambda out: sorted(str(x.doc_id) for x in out.collect())
    want = ["1", "1", "1", "None", "None"]
    path, pattern = queries.vocabulary()
    nothing = spark.createDataFrame([], "item_id long, text string")
    for out in (langid.identify(df, model), toxicity.score(df, toxicity.Model(None, np.zeros(3), -3.0)), bpe.encode(df, path, pattern), pii.find(df), decontam.find_contamination(df, nothing), suffix.remove_repeats(df), linededup.dedup_lines(df), neardup.components(df)):
        assert ids(out) == want
    empty = df.where("false")
    for out in (pii.find(empty), toxicity.score(empty, toxicity.Model(None, np.zeros(3), -3.0)), chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))):
        assert out.count() == 0
