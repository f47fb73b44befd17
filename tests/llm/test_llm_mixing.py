"""Mixing, spelling variants and token alignment against plain code."""

import gc
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from nearkin.llm import alignment, mixing, queries, spelling
from tests.llm.test_llm_text import prose


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture()
def folder(spark, tmp_path):
    def write(rows):
        path = str(tmp_path / f"sf{len(list(tmp_path.iterdir()))}")
        spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
        return path

    return write


# --- mixing


def shared_out(sizes, weights, total, cap):
    """Targets by resharing the excess again and again."""
    full = {}
    while True:
        left = [s for s in sizes if s not in full]
        rest = total - sum(full.values())
        told = {s: rest * weights[s] / sum(weights[x] for x in left) for s in left}
        over = [s for s in left if told[s] > cap * sizes[s]]
        if not over:
            return {**told, **full}
        full.update({s: cap * sizes[s] for s in over})


def test_targets_reshare_the_excess(spark):
    r = random.Random(7)
    for _ in range(4):
        sizes = {s: r.choice([0, 3, 50, 400, 9000]) + r.randint(0, 40) for s in ["b", "a", "Z", "é", "", None, "c"]}
        order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
        weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {x["source"]: x["target"] for x in mixing.targets(df).collect()}
        expected = shared_out(sizes, weights, 1.5 * sum(sizes.values()), 2)
        assert got == pytest.approx(expected)


def test_word_count(spark):
    texts = ["", None, " ", "a", " a  b\t\nc ", "a\x0bb\x1fc\xa0d", "x" * 50_000 + " y" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", mixing.word_count("text").alias("n"))
    assert {x["i"]: x["n"] for x in df.collect()} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}


def test_mix_is_systematic(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN_ROWS", 7)
    r = random.Random(3)
    rows = [(i, r.choice(["hot"] * 4 + ["b", None, "c"]), int(r.lognormvariate(4, 1)), r.choice("xy")) for i in range(900)]
    rows += [(5000, "hot", 60, "x")] * 40 + [(None, "b", None, "z"), (None, "b", 9, "z"), (1, "empty", 0, "u"), (2, None, 4, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long, target string").withColumn("copies", F.lit("clash"))
    got = rows_of(mixing.mix(df, F.col("n")))
    assert len(got) == len(rows) and set(got[0]) == {"doc_id", "source", "n", "size", "source_size", "target", "copies"}
    again = rows_of(mixing.mix(df.repartition(7), F.col("n")))
    assert sorted(map(str, again)) == sorted(map(str, got))
    for source in {x["source"] for x in got}:
        mine = [x for x in got if x["source"] == source]
        size, target = sum(x["size"] for x in mine), mine[0]["target"]
        assert {x["source_size"] for x in mine} == {size}
        # Each place of the order gets the whole numbers that its part of the sum crosses; words follow the target.
        each = target / size if size else 0
        assert all(x["copies"] in (int(each), int(each) + 1, 2 * (each == 2)) for x in mine)
        assert abs(sum(x["copies"] for x in mine) - each * len(mine)) <= 1
        assert abs(sum(x["copies"] * x["size"] for x in mine) - target) <= max(x["size"] for x in mine)
    taken = mixing.take(mixing.mix(df, F.col("n")))
    assert taken.count() == sum(x["copies"] for x in got) and "copy" in taken.columns


def test_mix_edge_tables(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(df, mixing.word_count("text")).count() == 0
    df = spark.createDataFrame([(1, "a", None), (2, "a", "")], "doc_id long, source string, text string")
    assert [(x["target"], x["copies"]) for x in mixing.mix(df, mixing.word_count("text")).collect()] == [(0.0, 0)] * 2


# --- spelling


def apart(a, b):
    """Whether exactly one edit makes one word of the other."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(docs, typos):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if typos and h % typos == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute_forms(words):
    out = {}
    near = {w: [v for v in words if apart(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def typo_texts(seed, n):
    """Documents over a small vocabulary whose words are often misspelt, in chains too."""
    r = random.Random(seed)
    base = ["".join(r.choice("aeiotrsnÉéß") for _ in range(r.randint(6, 11))) for _ in range(25)] + ["Garden" + "s" * k for k in range(4)]
    weight = [r.choice([1, 5, 40, 300]) for _ in base]

    def word():
        w = r.choices(base, weight)[0]
        for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2])):
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("aes") + w[i:], w[:i] + r.choice("aeis") + w[i + 1 :]])
        return w

    return [(i, " ".join(word() for _ in range(150)) + ".short, a-b ABC") for i in range(n)]


def test_spellings_equal_brute_force(spark, folder):
    docs = typo_texts(1, 60) + [(None, "Vineyard " * 7), (7, None), (8, ""), (9, "x" * 40_000 + " "), (9, "y" * 5), (9, "vineyards " * 40)]
    got = rows_of(queries.op12_reduced_spellings(spark, folder([(i, t, "s") for i, t in docs])))
    expected = brute_forms(brute_words(docs, 199))
    assert {x["word"]: (x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in got} == expected
    assert len(got) == len(expected) and any(x["root"] not in (x["form"], x["word"]) for x in got)


def test_typos_are_planted(spark):
    docs = [(i, "Wonderful gardens " * (i % 3 + 1)) for i in range(400)] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string")
    counts = {x["word"]: x["n"] for x in spelling.word_counts(df, typos=5).collect()}
    got = {w: n for w, n in counts.items() if n >= 5}
    assert got == brute_words(docs, 5) and len(got) > 5


@pytest.mark.parametrize(("symbols", "crowd"), [(2, 3), (8, 1000)])
def test_near_words_of_crowded_forms(spark, symbols, crowd):
    words = brute_words(typo_texts(2, 25), 0)
    words.update({"ab" * 400: 6, "ab" * 400 + "c": 9, "ÿ" * 6: 5})
    vocab = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [(x["word"], x["near"], x["near_n"]) for x in spelling.near_words(vocab, symbols, crowd).collect()]
    assert len(got) == len(set(got)) and set(got) == {(w, v, words[v]) for w in words for v in words if apart(w, v)}


def test_neighbour_keys_are_all_edits(monkeypatch):
    letters = {}
    for c in "abcdefgh":
        letters.setdefault(int(spelling._symbols([c], 4)[0, 0]), c)
    assert len(letters) > 2
    reduced = list(letters.values())
    for word in ("abcde", "aaaaaa", "h"):
        edits = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
        edits |= {word[:i] + c + word[j:] for i in range(len(word) + 1) for j in (i, i + 1) for c in reduced}
        want = {int(spelling.reduced_keys([w], 4)[0]) for w in edits if w}
        for held in (1 << 20, 1):
            monkeypatch.setattr(spelling, "HELD_KEYS", held)
            blocks = list(spelling.neighbour_keys([word], 4))
            got = {int(k) for _, keys in blocks for k in keys}
            assert want <= got and all(len(keys) == len(set(keys.tolist())) for _, keys in blocks)


def test_no_words(spark):
    df = spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(df)).count() == 0


# --- alignment


@pytest.fixture(scope="module")
def files():
    return [alignment.read_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def brute_align(text, files):
    """Groups and link counts of one text from decoded tokens only."""
    if not text:
        return (0, 0, 0, 0, ""), Counter()
    a_tool = Tokenizer.from_str(files[0].decode())
    a_tool.encode_special_tokens = True
    b_tool = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    to_byte = alignment.byte_chars()
    a, b = a_tool.encode(" " + text, add_special_tokens=False).ids, b_tool.encode(text, return_type=int)
    a_bytes = [bytes(to_byte[c] for c in a_tool.id_to_token(i)) for i in a]
    pieces = [b_tool.id_to_piece(i) for i in b]
    b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
    data = b" " + text.encode()
    if b"".join(a_bytes) != data or b"".join(b_bytes) != data:
        return (0, 0, 0, 0, ""), Counter()
    a_ends, b_ends = (np.cumsum([len(t) for t in tokens]).tolist() for tokens in (a_bytes, b_bytes))
    links, groups, i, j = Counter(), [], 0, 0
    for cut in sorted(set(a_ends) & set(b_ends)):
        x, y = a_ends.index(cut) + 1, b_ends.index(cut) + 1
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        links.update((p, q) for p in a[i:x] for q in b[j:y])
        i, j = x, y
    return (len(a), len(b), len(groups), links.total(), hashlib.sha256(";".join(groups).encode()).hexdigest()), links


def odd_texts():
    r = random.Random(9)
    signs = "abcde  \n\t.,'sétößñ0123½一二🎉\u0085\xa0\x1c²ªЖ▁<>|鱻 ̈ﬁ"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(1, 50))) for _ in range(120)]
    texts += [prose(i, 40) for i in range(10)] + ["<|endoftext|> x", "</s> <s>a <0x41>", "a" * 900, " a", "  ", "a  b ", " ", "é" * 90, "鱻" * 40]
    return texts + [None, "", "don't WE'LL it's", texts[3], texts[3], "the house " * 3000]


def test_aligner_learns_without_collecting(files, monkeypatch):
    aligner, seen = alignment.Aligner(*files), []
    learn = aligner.learn
    monkeypatch.setattr(aligner, "learn", lambda chunks: seen.append((gc.isenabled(), sorted(chunks))) or learn(chunks))
    first = aligner.linked(["one two, one", "\ntwo three ", None, ""])
    assert seen == [(False, ["\ntwo", "one", "three ", "two,"])] and gc.isenabled()
    again = aligner.linked(["one two, one", "\ntwo three ", None, ""])
    assert len(seen) == 1 and [r[:5] for r in again] == [r[:5] for r in first] and [r[0] > 0 for r in first] == [True, True, False, False]
    monkeypatch.setattr(aligner, "learn", lambda chunks: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        aligner.linked(["four"])
    assert gc.isenabled()


def test_alignment_equals_brute_force(spark, folder, files, monkeypatch):
    monkeypatch.setattr(alignment, "COMMON_LINKS", 40)
    docs = list(enumerate(odd_texts())) + [(None, "the house"), (4, "again 4")]
    expected = [brute_align(t, files) for _, t in docs]
    held = Counter(link for _, links in expected for link in links)
    most = Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    want = sorted(
        str((i, *row, sum(n for link, n in links.items() if held[link] == most[link[0]]), sum(n * held[link] for link, n in links.items())))
        for (i, _), (row, links) in zip(docs, expected)
    )
    rows = rows_of(alignment.align(spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_best", F.lit("x")), *files))
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    assert sorted(str(tuple(x[n] for n in names)) for x in rows) == want
    assert sum(row[0] > 0 for row, _ in expected) > 60 and sum(row[0] == 0 for row, _ in expected) > 10
    query = rows_of(queries.op13_token_spans(spark, folder([(i, t, "s") for i, t in docs])))
    assert sorted(str(tuple(x[n] for n in names)) for x in query) == want


def test_spans_cut_characters_and_bytes(spark, files):
    text = "鱻 é🎉 house"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    row = {x["doc_id"]: x for x in alignment.spans(df, *files).collect()}
    assert row[2]["cuts"] == [] and row[1]["a_ends"][-1] == row[1]["b_ends"][-1] == len(text.encode()) + 1
    assert set(row[1]["cuts"]) == set(row[1]["a_ends"]) & set(row[1]["b_ends"])
    # B writes the first sign in three byte tokens.
    assert {2, 3, 4} <= set(row[1]["b_ends"]) and len(set(row[1]["b_ends"])) == len(row[1]["b_ids"])
    assert alignment.align(df.limit(0), *files).count() == 0


def test_large_groups_and_full_memory(files, monkeypatch):
    texts = [t for t in odd_texts() if t]
    aligner = alignment.Aligner(*files)
    plain = aligner.linked(texts)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 1)
    monkeypatch.setattr(alignment, "MAX_CHUNKS", 20)
    monkeypatch.setattr(alignment, "MAX_CHUNK_CHARS", 3)
    aligner = alignment.Aligner(*files)
    for text, expected in zip(texts, plain):
        row = aligner.linked([text])[0]
        assert row[:5] == expected[:5] and row[5].tolist() == expected[5].tolist() and row[6].tolist() == expected[6].tolist()
    whole = aligner.learn(texts)
    for text, expected in zip(texts, plain):
        assert whole[text] is False if not expected[0] else whole[text][:4] == expected[:4]
